"""Phrases against a plain count of everything."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistalog.llm import phrases

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top, longest=5):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        often = {g: a for g, a in f.items() if a >= least and len(g) > 1}
        inside = {(g[i : i + m], a) for g, a in often.items() for m in range(2, len(g)) for i in range(len(g) - m + 1)}
        found = []
        for g, a in often.items():
            if (g, a) in inside:
                continue
            score, _, l, r = min((1000 * a * total[lang] // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus(rng, n=120):
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "Ab", "日本", "x y", "a", "a"]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    fixed = ["the old stone bridge over", "w1 W2 w3 w4 w5 w6 w7", "a a a a a a", "b\tb"]
    rows = []
    for _ in range(n):
        words = rng.choice(vocabulary, rng.integers(0, 60), p=weights / weights.sum()).tolist()
        for s in rng.choice(fixed, rng.integers(0, 3)):
            words.insert(int(rng.integers(len(words) + 1)), str(s))
        text = "".join(w + str(rng.choice([" ", " ", " ", "  ", ". ", "\n", "\r\n", "\x0b", ",", " ! "])) for w in words)
        rows.append((str(rng.choice(["en", "fr", "und"])), text))
    return [*rows, (None, "a a a w1 w2 w3"), (None, "a a a w1 w2 w3"), ("en", None), ("en", ""), ("de", " \t\n.,"), rows[0], rows[0], ("fr", "long words " * 5000)]


@pytest.mark.parametrize("least, top, shares", [(3, 12, (1 / 16, 1 / 4, 1.0)), (2, 2000, (1.0,)), (4, 5, (0.02, 0.1, 0.3, 1.0))])
def test_phrases_equal_a_plain_count(spark, least, top, shares):
    rows = corpus(np.random.default_rng(least))
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as id", "2 as f", "3 as g", "'x' as phrase")
    got = sorted(tuple(r) for r in phrases.mine(docs, least=least, top=top, shares=shares).collect())
    assert got == plain(rows, least, top)


def test_early_languages_stop_and_ties_are_settled(spark):
    rare = [("en", f"r{i} s{i}. " * 3) for i in range(40)]
    usual = [("en", "the of and " * 400), ("fr", "le la " * 3)]
    rows = rare + usual
    got = sorted(tuple(r) for r in phrases.mine(spark.createDataFrame(rows, "lang string, text string"), least=3, top=10, shares=(0.1, 1.0)).collect())
    assert got == plain(rows, 3, 10) and [r[2] for r in got if r[0] == "en"][:3] == ["r0 s0", "r1 s1", "r10 s10"]


def test_empty_and_without_phrases(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert phrases.mine(empty).collect() == []
    assert phrases.mine(spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")).collect() == []
    assert phrases.mine(spark.createDataFrame([("en", "a.a.a.")], "lang string, text string"), least=2).collect() == []


def test_filter_holds_all_members(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("h"))
    f = phrases.Filter.of(df, "h")
    members = np.array([r["h"] for r in df.collect()], np.int64).view(np.uint64)
    assert f.has(members).all()
    assert f.has(members + np.uint64(1)).mean() < 0.1
    small = phrases.Filter.of(df, "h", most_bits=phrases._SEGMENT)
    assert small.has(members).all()


def test_words_of_later_waves_that_pass_the_filter_of_an_earlier_one_count_once(spark):
    """8000 rare words fill 3 % of the first wave's filter, so dozens of the 1500 usual ones pass it."""
    rare = [("en", f"r{i} r{i + 1}. " * 2) for i in range(0, 8000, 2)]
    usual = [("en", f"u{i} u{i + 1}. " * 160) for i in range(0, 1500, 2)]
    rows = rare + usual
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(4)
    got = sorted(tuple(r) for r in phrases.mine(docs, least=2, top=4500, shares=(1 / 16, 1.0)).collect())
    assert len({r[2] for r in got}) == len(got)
    assert got == plain(rows, 2, 4500)
