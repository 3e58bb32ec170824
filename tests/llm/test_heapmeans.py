"""Clusters against a plain run over all vectors in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from vistalog.llm import heapmeans


def plain(rows, k, rounds, dim, seed=3, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (away(v, centroids[c]), c))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        for c in range(len(centroids)):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if members:
                centroids[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    own = [nearest(v) for _, v in kept]
    d = [away(v, centroids[o]) for (_, v), o in zip(kept, own, strict=True)]
    by = {c: sum(x for x, o in zip(d, own, strict=True) if o == c) for c in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, o, x, by[o], sum(d), sha[o]) for (i, _), x, o in zip(kept, d, own, strict=True)), key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as cluster", "1 as block", "2 as v")
    return sorted((tuple(r) for r in heapmeans.cluster(df, **more).collect()), key=str)


def made(rng, n, dim, spread):
    centres = rng.normal(size=(5, dim))
    return [(i, (centres[rng.integers(5)] + spread * rng.normal(size=dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread, block", [(0.2, 2000), (1.0, 37), (3.0, 64)])
def test_clusters_equal_plain_runs(spark, spread, block):
    rows = made(np.random.default_rng(int(10 * spread)), 400, 6, spread)
    rows += [(400, rows[3][1]), (3, rows[3][1]), (401, None), (402, [1.0] * 5), (403, [float("nan")] * 6), (404, [None] + [1.0] * 5), (405, [float("inf")] + [0.0] * 5), (406, []), (None, [0.5] * 6), (407, [1000.0] * 6)]
    assert run(spark, rows, k=4, rounds=10, dim=6, block=block) == plain(rows, 4, 10, 6)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(x), float(y)]) for i, (x, y) in enumerate((x, y) for x in range(6) for y in range(6))]
    assert run(spark, rows, k=8, rounds=10, dim=2, scale=2) == plain(rows, 8, 10, 2, scale=2)
    same = [(i, [0.25, -0.25]) for i in range(20)]
    assert run(spark, same, k=3, rounds=5, dim=2) == plain(same, 3, 5, 2)


def test_few_and_no_vectors(spark):
    rows = [(1, [0.1, 0.2]), (2, [-3.0, 0.4]), (None, [9.0, 9.0])]
    assert run(spark, rows, k=8, rounds=3, dim=2) == plain(rows, 8, 3, 2)
    assert run(spark, [(1, [0.1])], dim=2) == []
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(1, [2.0**20, 0.0])], dim=2)


def test_only_vectors_with_a_used_up_gap_are_popped(spark):
    rows = made(np.random.default_rng(8), 300, 4, 0.05)
    df = heapmeans.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 4, 1024)
    blocks = heapmeans.blocks_of(df, 4, 50).cache()
    far = np.array([[-4000] * 4, [4000] * 4], np.int64)
    state = heapmeans.assigned(blocks, far).cache()
    same = heapmeans.rescanned(state, blocks, far, [0.0, 0.0])
    assert {r["block"]: r["keys"] for r in same.collect()} == {r["block"]: r["keys"] for r in state.collect()}
    assert all(r["moved"] is None for r in same.collect())
    top = min(t for r in state.collect() for t in r["tops"])
    changed = heapmeans.rescanned(state, blocks, far, [top, top]).collect()
    assert 1 <= sum(r["moved"] is not None for r in changed) < len(changed)
    for r in changed:
        for a, b in zip(np.cumsum([0, *r["sizes"]])[:-1], np.cumsum(r["sizes"]), strict=True):
            keys = np.frombuffer(r["keys"])[a:b]
            assert all(keys[(i - 1) // 2] <= keys[i] for i in range(1, len(keys)))
