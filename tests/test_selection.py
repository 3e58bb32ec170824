"""Quotas, k centres and splits against plain versions."""

import random
from collections import Counter, defaultdict

import pytest

from vistalog.operators import diverse, exports


def greedy(rows, k):
    """rows: id, score, x, y, key."""
    far = lambda a, b: (a[2] - b[2]) ** 2 + (2.0 * a[3] - 2.0 * b[3]) ** 2 + (a[4] != b[4])
    left, out = sorted(rows, key=lambda r: (-r[1], r[0])), []
    while left and len(out) < k:
        near = lambda r: min((far(r, c) for c, _ in out), default=None)
        r = min(left, key=lambda r: (-(near(r) or 0), -r[1], r[0])) if out else left[0]
        out.append((r, near(r)))
        left.remove(r)
    return [(r[0], i + 1, d) for i, (r, d) in enumerate(out)]


@pytest.mark.parametrize("batch", [1, 3, 16, 1024])
@pytest.mark.parametrize("clustered", [False, True])
def test_centres_are_the_greedy_ones(spark, batch, clustered):
    rnd = random.Random(batch)
    at = [(rnd.uniform(0, 100), rnd.uniform(0, 100)) for _ in range(5)]
    point = lambda: tuple(float(round(c + rnd.gauss(0, 1))) for c in rnd.choice(at)) if clustered else (float(rnd.randint(0, 9)), float(rnd.randint(0, 9)))
    rows = [(f"r{i}", round(rnd.random(), 1), *point(), rnd.choice("abc")) for i in range(150)]
    df = spark.createDataFrame(rows, "scene_id string, score double, x double, y double, kind string").repartition(4)
    got = diverse.k_centres(df, 12, {"x": 1.0, "y": 2.0}, ["kind"], batch=batch).select("scene_id", "chosen_rank", "distance").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == greedy(rows, 12)


def test_centres_of_odd_rows(spark):
    kind = "scene_id string, score double, x double, kind string, d int, chosen string"
    odd = [("a", None, None, None, 1, "z"), ("b", float("nan"), float("inf"), "k", 1, "z"), (None, 9.0, 100.0, "k", 1, "z"), ("c", 1.0, 3.0, None, 1, "z"), ("c", 1.0, 3.0, None, 1, "z")]
    got = {r["scene_id"]: (r["chosen_rank"], r["distance"]) for r in diverse.k_centres(spark.createDataFrame(odd, kind), 10, {"x": 1.0}, ["kind"]).collect()}
    assert got == {"c": (1, None), "b": (2, 10.0), "a": (3, 1.0)}
    assert diverse.k_centres(spark.createDataFrame([], kind), 3, {"x": 1.0}).collect() == []


def test_quotas_follow_weights_and_pass_on_what_is_left(spark):
    rows = [(f"{g}{i:03}", i / 1000, g) for g, n in (("a", 500), ("b", 100), ("c", 3)) for i in range(n)] + [("n1", None, None), ("z1", 1.0, "out")]
    df = spark.createDataFrame(rows, "scene_id string, score double, g string")
    from pyspark.sql import functions as F

    w = F.when(F.col("g") == "a", 2.0).when(F.col("g") == "out", 0.0).otherwise(1.0)
    got = diverse.balanced(df, 64, ["g"], w).collect()
    assert Counter(r["g"] for r in got) == {"a": 40, "b": 20, "c": 3, None: 1}
    assert sorted(r["chosen_rank"] for r in got) == list(range(1, 65)) and {r["scene_id"] for r in got if r["g"] == "b"} == {f"b{i:03}" for i in range(80, 100)}
    assert diverse.balanced(df.limit(0), 5, ["g"]).collect() == []


def test_splits_keep_groups_and_shares(spark):
    rnd = random.Random(3)
    rows = [(i, f"g{rnd.randint(0, 400)}" if i % 3 else "hot", rnd.choice("ab")) for i in range(6000)] + [(6000 + i, f"one{i}", "c") for i in range(1000)] + [(9000, None, None)]
    out = exports.stratified_split(spark.createDataFrame(rows, "id long, g string, s string"), "g", ["s"]).collect()
    assert sorted(r["id"] for r in out) == [r[0] for r in rows]
    splits = defaultdict(set)
    for r in out:
        splits[r["g"]].add(r["split"])
    assert all(len(s) == 1 for s in splits.values())
    assert Counter(r["split"] for r in out if r["s"] == "c") == {"train": 800, "val": 100, "test": 100}
    by_hand = Counter(r["split"] for r in out if r["g"] != "hot" and r["s"] in ("a", "b"))
    assert set(by_hand) == {"train", "val", "test"}
    with pytest.raises(ValueError):
        exports.stratified_split(spark.createDataFrame(rows, "id long, g string, s string"), "g", ["s"], (("train", 80),))


def test_exports_are_whole_and_indexed(spark, tmp_path):
    rows = spark.range(1000).selectExpr("cast(id as string) scene_id", "id % 7 as g")
    cut = exports.stratified_split(rows, "scene_id")
    boxes = spark.range(9000).selectExpr("case when id % 3 = 0 then '5' else cast(id % 1500 as string) end as scene_id", "id as box", "'x' as split")
    path = str(tmp_path / "out")
    index = exports.export(cut, {"annotations": boxes}, path, rows_per_shard=60)
    n = {(r["table"], r["split"]): r["n"] for r in index.groupBy("table", "split").agg({"row_count": "sum"}).withColumnRenamed("sum(row_count)", "n").collect()}
    assert (n["scenes", "train"], n["scenes", "val"], n["scenes", "test"]) == (800, 100, 100)
    assert index.where("table = 'scenes'").groupBy("split").count().collect() and index.where("table = 'scenes' and split = 'train'").count() == 14
    back = spark.read.parquet(f"{path}/annotations")
    assert back.count() == boxes.where("cast(scene_id as long) < 1000").count() and back.join(spark.read.parquet(f"{path}/scenes"), ["scene_id", "split", "shard"]).count() == back.count()
    assert exports.export(cut.limit(0), {}, str(tmp_path / "none")).collect() == []
