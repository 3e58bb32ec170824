"""What several operators share: the shared folder, batches of texts, connected components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (tests) a temporary folder is made and set; a cluster must name one.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not at:
        at = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at


#: Spark's own bounds of an Arrow batch, and those that fit beside a heap that is in use: a batch exists several times, in
#: the JVM, in the worker and as Python strings.
_ARROW = {"maxRecordsPerBatch": ("10000", "2000"), "maxBytesPerBatch": ("67108864b", "4194304b")}


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of the session in rows and bytes where it has Spark's defaults; other settings stay."""
    for name, (default, bound) in _ARROW.items():
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", bound)


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: later steps read it again instead of computing it again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer over an array of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(lengths: list[int], most: int):
    """Consecutive index ranges whose lengths sum to about ``most``; one long item is a range of its own."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected links: (node, component), component the smallest node reachable.

    ``edges`` has long columns ``a`` and ``b``; nodes without a link are absent from the result. Alternates
    large-star and small-star steps; each round is a checkpoint in the shared folder, so that a lost executor
    costs one round. Hot nodes meet partial aggregation and a join that Spark may split.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if large:
            moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    before = mark(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        now = star(star(now, True), False).checkpoint()
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
