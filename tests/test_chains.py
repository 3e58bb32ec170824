"""Paths over time buckets against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistalog.operators import chains


def plain(times, beyond, most):
    out, first, count, part = [], None, 0, -1
    for t in times:
        if first is None or t - first > beyond or (most and count >= most):
            first, count, part = t, 0, part + 1
            out.append((part, True))
        else:
            out.append((part, False))
        count += 1
    return out


@pytest.mark.parametrize("beyond, most, width", [(7, None, None), (7, 3, 7), (7, 3, 10), (0, None, 1), (0, 2, None), (30, 5, 30), (500, 4, 500), (7, 1, 9)])
def test_paths_equal_loops(spark, beyond, most, width):
    rng = np.random.default_rng(beyond + (most or 0))
    rows, want = [], {}
    for key in ("a", "b", "c", "d", "e"):
        n = {"a": 400, "b": 90, "c": 1, "d": 300, "e": 60}[key]
        times = np.sort(rng.integers(0, {"a": 900, "b": 4000, "c": 5, "d": 40, "e": 60}[key], n)) - (200 if key == "b" else 0)
        if key == "e":
            times = np.sort(np.concatenate([times[:20], times[20:40] + 5000, times[40:] + 5000 + 7 * 16]))
        for i, (t, w) in enumerate(zip(times.tolist(), plain(times.tolist(), beyond, most), strict=True)):
            rows.append((key, t, i))
            want[key, i] = w
    df = spark.createDataFrame(rows, "k string, t long, pos long").withColumn("node", F.lit("clash")).repartition(3)
    out = chains.chained(df, ["k"], ["t", "pos"], beyond, most, width)
    assert {(r["k"], r["pos"]): (r["part"], r["first"]) for r in out.collect()} == want
    assert out.columns == [*df.columns, "part", "first"]


def test_no_rows_and_narrow_buckets(spark):
    df = spark.createDataFrame([], "k string, t long, pos long")
    assert chains.chained(df, ["k"], ["t", "pos"], 5).collect() == []
    with pytest.raises(ValueError, match="as wide"):
        chains.chained(df, ["k"], ["t", "pos"], 5, bucket_us=4)


def test_one_long_key_is_many_tasks(spark):
    df = spark.range(0, 200_000, 1, 8).select(F.lit("k").alias("k"), (F.col("id") * 10).alias("t"), F.col("id").alias("pos"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = chains.chained(df, ["k"], ["t", "pos"], 95).withColumn("task", F.spark_partition_id())
        assert out.where("part <> floor(pos / 10) or first <> (pos % 10 = 0)").isEmpty()
        sizes = [r["count"] for r in out.groupBy("task").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 100_000
