"""Rotations between poses against numpy, and distributions over sets of columns against counts."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistalog.functions import geometry
from vistalog.operators import associate, views


def between(p, q, k):
    p, q = np.array(p) / np.linalg.norm(p), np.array(q) / np.linalg.norm(q)
    q = -q if p @ q < 0 else q
    arc = math.acos(min(1.0, abs(p @ q)))
    out = p * (1 - k) + q * k if arc < 1e-5 else (math.sin((1 - k) * arc) * p + math.sin(k * arc) * q) / math.sin(arc)
    return out / np.linalg.norm(out)


def test_slerp_equals_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist(), rng.normal(size=4).tolist(), float(rng.random())) for i in range(200)]
    rows += [(900, [1.0, 0, 0, 0], [1.0, 0, 0, 0], 0.3), (901, [1.0, 0, 0, 0], [-1.0, 0, 0, 0], 0.3), (902, [2.0, 0, 0, 0], [0.0, 0, 0, 5.0], 0.5), (903, [1.0, 1e-9, 0, 0], [1.0, 0, 0, 0], 0.5)]
    rows += [(904, [1.0, 0, 0, 0], None, 0.5), (905, [0.0, 0, 0, 0], [1.0, 0, 0, 0], 0.5)]
    df = spark.createDataFrame([(i, [*map(float, p)], q and [*map(float, q)], k) for i, p, q, k in rows], "i long, p array<double>, q array<double>, k double")
    got = {r["i"]: r["m"] for r in df.select("i", geometry.slerp(F.col("p"), F.col("q"), F.col("k")).alias("m")).collect()}
    for i, p, q, k in rows[:-2]:
        assert np.allclose(got[i], between(p, q, k), atol=1e-9), i
    assert got[904] is None and got[905] is None


def test_transforms_between_poses(spark):
    half = math.sqrt(0.5)
    poses = [("a", 0, [0.0, 0.0, 0.0], [1.0, 0.0, 0.0, 0.0], 0), ("b", 100, [10.0, 20.0, 0.0], [half, 0.0, 0.0, half], 1), ("c", 400, [0.0, 0.0, 9.0], [1.0, 0.0, 0.0, 0.0], 2)]
    df = spark.createDataFrame(poses, "ego_pose_id string, timestamp_us long, translation array<double>, rotation array<double>, pos long")
    frames = spark.createDataFrame([(t,) for t in (0, 50, 100, 250, 405)], "timestamp_us long")
    got = {r["timestamp_us"]: (r["translation"], r["rotation"]) for r in associate.interpolated_transform(frames, df, 150).collect()}
    assert got[50][0] == [5.0, 10.0, 0.0] and np.allclose(got[50][1], [math.cos(math.pi / 8), 0, 0, math.sin(math.pi / 8)])
    assert got[0][0] == [0.0, 0.0, 0.0] and got[100][0] == [10.0, 20.0, 0.0] and got[250][0] == [5.0, 10.0, 4.5] and got[405] == (None, None)
    assert set(associate.interpolated_transform(frames, df.limit(0), 150).select("rotation").collect()) == {(None,)}


@pytest.mark.parametrize("n", [0, 200])
def test_distribution_sets_equal_counts(spark, n):
    rng = np.random.default_rng(2)
    rows = lambda k: [(str(rng.choice(["a", "b"])) if rng.random() < 0.9 else None, int(rng.integers(k)), "z") for _ in range(n)]
    left, right = rows(3), [*rows(4), ("only", 1, "z")]
    kind = "c string, s int, other string"
    out = views.distribution_sets(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), [["c"], ["s", "c"]]).collect()
    got = {(r["compared"], r["c"], r["s"]): (r["left_share"], r["right_share"]) for r in out}
    want = {}
    for name, key in (("c", lambda r: (r[0], None)), ("s+c", lambda r: (r[0], r[1]))):
        a, b = Counter(map(key, left)), Counter(map(key, right))
        want |= {(name, *k): (a[k] / len(left) if left else 0.0, b[k] / len(right)) for k in a | b}
    assert got == want
    assert {(r["total_left"], r["total_right"]) for r in out} == {(len(left), len(right))}
