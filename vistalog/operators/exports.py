"""Exports of dataset versions: splits that keep groups whole and shares exact in each stratum, and shards with an index."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .steps import written

SHARES = (("train", 80), ("val", 10), ("test", 10))
#: Hexadecimal digits of a group's hash that name its slot, so a stratum has at most 65 536 slots.
_DIGITS = 4


def group_splits(rows: DataFrame, group: str, strata: Sequence[str] = (), shares: Sequence[tuple[str, int]] = SHARES, seed: str = "") -> DataFrame:
    """_group, _rows and split, a row for each value of ``group``; see stratified_split()."""
    if sum(n for _, n in shares) != 100 or any(n < 0 for _, n in shares):
        raise ValueError("shares must be parts of 100 that add up to it")
    own = [f"_s{i}" for i in range(len(strata))]
    named = rows.select(F.col(group).alias("_group"), *[F.col(c).alias(n) for c, n in zip(strata, own, strict=True)])
    counted = named.groupBy("_group", *own).agg(F.count("*").alias("_c"))
    home = counted.groupBy("_group").agg(F.sum("_c").alias("_rows"), F.min(F.struct((-F.col("_c")).alias("c"), *own)).alias("h"))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_group").cast("string"), F.lit(""))).cast("binary"), 256)
    placed = home.select("_group", "_rows", *[F.col(f"h.{n}").alias(n) for n in own], hashed.alias("_hash"), F.substring(hashed, 1, _DIGITS).alias("_slot"))
    sums = placed.groupBy(*own, "_slot").agg(F.sum("_rows").alias("_n"))
    in_stratum = Window.partitionBy(*own) if own else Window.partitionBy(F.lit(1))
    before = F.sum("_n").over(in_stratum.orderBy("_slot")) - F.col("_n")
    starts = sums.select(*[F.col(n).alias(f"b{n}") for n in own], F.col("_slot").alias("b_slot"), before.alias("_before"), F.sum("_n").over(in_stratum).alias("_total"))
    same = F.col("_slot") == F.col("b_slot")
    for n in own:
        same = same & F.col(n).eqNullSafe(F.col(f"b{n}"))
    along = F.sum("_rows").over(Window.partitionBy(*own, "_slot").orderBy("_hash", F.col("_group").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    # Twice the middle of a group's rows in its stratum.
    middle = (F.col("_before") + F.col("_in")) * 2 - F.col("_rows")
    top, out = 0, None
    for name, n in shares:
        top += n
        here = middle * 50 < F.col("_total") * top
        out = F.when(here, name) if out is None else out.when(here, name)
    return placed.withColumn("_in", along).join(starts, same).select("_group", "_rows", out.alias("split"))


def stratified_split(rows: DataFrame, group: str, strata: Sequence[str] = (), shares: Sequence[tuple[str, int]] = SHARES, seed: str = "") -> DataFrame:
    """``rows`` with a split; rows of one ``group`` are in one split, and shares of rows hold in each stratum.

    A group belongs to the stratum of most of its rows, ties to the smallest, a null before others. Groups of a stratum stand in the
    order of a hash of ``seed`` and group, and one goes to the split in which the middle of its rows lies, so each border is off
    by at most half a group; groups of one row give exact shares. Rows whose group is null are one group.

    Counts go up from groups to slots of the hash, and only slots, at most 65 536 of a stratum, are added up along it, so a
    stratum with any number of groups is spread over many tasks.
    """
    chosen = group_splits(rows, group, strata, shares, seed)
    return rows.join(chosen.select("_group", "split"), F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def export(rows: DataFrame, tables: Mapping[str, DataFrame], path: str, key: str = "scene_id", rows_per_shard: int = 10_000, name: str = "scenes") -> DataFrame:
    """Write ``rows`` (``key``, split and more) and ``tables`` that have ``key``, each to a folder of ``path`` by split and shard; the index.

    The number of a split's shards follows from its rows. A table's rows stand in the split and shard of their key, and those of
    other keys are left out. The index has table, split, shard, row_count, first_key and last_key, and is written last, so an
    export without ``index`` is not a whole one. Rows are staged in the shared folder with their places; shards are written and the
    index is counted from there, as shards are many small files, slow to list and to open. Spark rebalances before it writes, which
    cuts a shard that is hot into several files, and tasks move their own files in place. ``path`` must be new.
    """
    staged = written(rows, "export")
    # A row for each split.
    needed = {r["split"]: r["n"] for r in staged.groupBy("split").agg(F.ceil(F.count("*") / rows_per_shard).alias("n")).collect()}
    if not needed:
        return rows.sparkSession.createDataFrame([], "table string, split string, shard long, row_count long, first_key string, last_key string")
    shards = F.create_map(*[F.lit(x) for kv in sorted(needed.items()) for x in kv])[F.col("split")]
    placed = staged.withColumn("shard", F.pmod(F.xxhash64(key), shards.cast("long")))
    put = lambda df, at: df.hint("rebalance", "split", "shard").write.partitionBy("split", "shard").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{path}/{at}")
    spark = rows.sparkSession
    where = placed.select(key, "split", "shard").distinct()
    index = None
    for at, df in {name: None, **tables}.items():
        df = placed if df is None else written(df.drop("split", "shard").join(where, key), "export")
        put(df, at)
        counted = df.groupBy("split", "shard").agg(F.count("*").alias("row_count"), F.min(F.col(key).cast("string")).alias("first_key"), F.max(F.col(key).cast("string")).alias("last_key"))
        counted = counted.select(F.lit(at).alias("table"), "split", "shard", "row_count", "first_key", "last_key")
        index = counted if index is None else index.unionByName(counted)
    index.write.parquet(f"{path}/index")
    return spark.read.schema(index.schema).parquet(f"{path}/index")
