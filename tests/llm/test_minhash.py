import random

import numpy as np
import pytest

from vistalog.llm import hyperminhash as H

WORDS = [f"w{i}" for i in range(400)]


def cloud(seed, groups, members, edits):
    """Texts of groups whose members differ from a centre by random word edits."""
    rnd, out = random.Random(seed), []
    for _ in range(groups):
        base = [rnd.choice(WORDS) for _ in range(rnd.randint(8, 160))]
        for _ in range(members):
            own = list(base)
            for _ in range(rnd.randint(0, edits)):
                own[rnd.randrange(len(own))] = rnd.choice(WORDS)
            out.append(" ".join(own))
    return out


def brute(texts, percent=85):
    sets = [set(H.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            inter = len(a & sets[j])
            if a and 100 * inter >= percent * (len(a) + len(sets[j]) - inter):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize(("tile", "salted"), [(1024, 512), (16, 4)])
def test_components_equal_brute_force(spark, tile, salted, monkeypatch):
    monkeypatch.setattr(H, "TILE", tile)
    monkeypatch.setattr(H, "SALTED", salted)
    texts = cloud(1, 6, 40, 4) + cloud(2, 30, 3, 2) + ["a b", "a b", "a  B", "b a", "A b"]
    rows = H.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    roots, sizes = brute(texts)
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in rows} == {i: (c, n) for i, (c, n) in enumerate(zip(roots, sizes, strict=True))}


def test_partitions_do_not_matter(spark):
    texts = cloud(5, 4, 20, 3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(H.near_duplicates(df.coalesce(1)).collect()) == sorted(H.near_duplicates(df.repartition(7)).collect())


def test_words_are_split_at_ascii_white_space_and_ascii_lowered():
    assert len(H.shingles("a\x0bb\x0cc\rd\ne")) == 1
    assert len(H.shingles("a b c d e f")) == 1
    assert (H.shingles("A B C D E") == H.shingles("a b c d e")).all()
    assert (H.shingles("É b c d e") != H.shingles("é b c d e")).all()


def test_estimate_is_close_to_similarity():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.85, 0.95):
        both = rng.integers(0, 2**63, 8000, dtype=np.uint64) * np.uint64(2)
        n = int(len(both) * (1 - share) / 2)
        a, b = np.unique(both[n:]), np.unique(both[: len(both) - n])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = H.estimate(H.registers(a)[None], H.registers(b)[None], np.array([len(a) * 1.0]), np.array([len(b) * 1.0]))[0]
        assert abs(got - true) < 0.12


def test_chance_collisions_are_taken_off():
    rng = np.random.default_rng(4)
    regs = np.stack([H.registers(np.unique(rng.integers(0, 2**63, 50_000, dtype=np.uint64) * np.uint64(2))) for _ in range(60)])
    n = np.full(30, 50_000.0)
    assert abs(H.estimate(regs[:30], regs[30:], n, n).mean()) < 0.002
