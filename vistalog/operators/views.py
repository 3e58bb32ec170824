"""Leaderboards and operational views over runs and jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .totals import with_totals

STATUSES = ("running", "failed", "succeeded", "pending")
KINDS = ("job", "pipeline_run", "execution")


def leaderboard(runs: DataFrame, order: str = "desc", limit: int = 50, offset: int = 0, global_rank: bool = False) -> DataFrame:
    """Runs (run_id, created_us, metric, summary_metric) by metric, nulls last, with rank.

    The newest page is taken first and ranked alone; a metric that is absent or zero gives way to the summary's. With
    ``global_rank`` all runs are ranked.
    """
    page = runs if global_rank else runs.orderBy(F.col("created_us").desc(), "run_id").offset(offset).limit(limit)
    value = F.coalesce(F.nullif("metric", F.lit(0.0)), F.expr("try_cast(summary_metric as double)"))
    by = F.col("value").desc_nulls_last() if order == "desc" else F.col("value").asc_nulls_last()
    if global_rank:
        valued = page.withColumn("value", value)
        return valued.join(_dense_ranks(valued.select("value").distinct(), by, order), F.col("value").eqNullSafe(F.col("_value"))).drop("_value")
    return page.withColumn("value", value).withColumn("rank", F.row_number().over(Window.orderBy(by, F.col("created_us").desc(), "run_id")).cast("long"))


def _dense_ranks(values: DataFrame, by: Column, order: str) -> DataFrame:
    """_value and rank of distinct doubles: ranked in ranges, and then the ranges' counts are added up.

    A range is a step of 1/64 of the binary logarithm on either side of zero, so there are some hundred thousand at most
    for all doubles, however many values there are; only their counts meet in one task.
    """
    v = F.col("value")
    size = F.floor(F.log2(F.abs(v)) * 64).cast("long") + 100_000
    slot = F.when(v.isNull(), None).when(F.isnan(v), 1_000_000).when(v == 0, 0).when(F.abs(v) == float("inf"), 500_000 * F.signum(v).cast("long")).otherwise(F.signum(v).cast("long") * size).cast("long")
    placed = values.withColumn("_slot", slot)
    first = F.col("_slot").desc_nulls_last() if order == "desc" else F.col("_slot").asc_nulls_last()
    counts = placed.groupBy("_slot").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_before", F.sum("_n").over(Window.orderBy(first)) - F.col("_n")).select(F.col("_slot").alias("_s"), "_before")
    ranked = placed.withColumn("_in", F.row_number().over(Window.partitionBy("_slot").orderBy(by)))
    return ranked.join(starts, F.col("_slot").eqNullSafe(F.col("_s"))).select(v.alias("_value"), (F.col("_before") + F.col("_in")).cast("long").alias("rank"))


def status_counts(jobs: DataFrame) -> DataFrame:
    """A row for each kind with the number of rows in each status; executions have no pending ones."""
    counts = jobs.where(F.col("status").isin(*STATUSES)).groupBy("kind").pivot("status", list(STATUSES)).count().na.fill(0)
    kinds = jobs.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    out = kinds.join(counts, "kind", "left").na.fill(0)
    return out.withColumn("pending", F.when(F.col("kind") == "execution", 0).otherwise(F.col("pending")).cast("long"))


def newest(jobs: DataFrame, kinds: Sequence[str], limit: int = 50, offset: int = 0, status: str | None = None) -> DataFrame:
    """The newest rows of the given kinds; ``offset`` counts in each kind, the cap in all together."""
    out = None
    for kind in kinds:
        own = jobs.where(F.col("kind") == kind)
        own = own.where(F.col("status") == status) if status else own
        own = own.orderBy(F.col("created_us").desc(), "job_id").offset(offset).limit(limit)
        out = own if out is None else out.unionByName(own)
    return out.orderBy(F.col("created_us").desc(), "job_id").limit(limit)


def event_log(events: DataFrame, level: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Events oldest first."""
    rows = events.where(F.col("level") == level) if level else events
    return rows.orderBy("created_us", "job_id").offset(offset).limit(limit)


def extracted(results: DataFrame, specs: DataFrame) -> DataFrame:
    """task_id, bucket, key and value of each output spec: a dot path into the result's JSON, or the default.

    ``specs`` has bucket, key, path, default_value and required, a few rows for each task type; a required value that
    is missing has missing true.
    """
    value = F.coalesce(F.expr("get_json_object(raw, concat('$.', path))"), "default_value")
    joined = results.join(specs, "task_type")
    return joined.select("run_id", "task_id", "task_order", "bucket", "key", value.alias("value"), (value.isNull() & F.col("required")).alias("missing"))


def run_results(values: DataFrame) -> DataFrame:
    """The last value that is not null, by task order, of each run, bucket and key."""
    w = Window.partitionBy("run_id", "bucket", "key").orderBy(F.col("task_order").desc(), F.col("task_id").desc())
    return values.where("value is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("run_id", "bucket", "key", "value")


def compare_runs(selection: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Scenes of a selection and an evaluation side by side, with the reason for which one was left out."""
    e = evaluated.select("scene_id").distinct().withColumn("_e", F.lit(True))
    joined = selection.select("scene_id", "selected", "reason").join(e, "scene_id", "full")
    yes = lambda c: F.coalesce(c, F.lit(False))
    skip = F.when(~yes("_e"), F.coalesce("reason", F.lit("eval_skipped")))
    return joined.select("scene_id", yes("selected").alias("selected"), yes("_e").alias("evaluated"), skip.alias("skip_reason"))


def distribution(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """Shares of a column's values in two versions, their difference, and its terms of the L1 distance and stability index.

    A value that one side lacks counts there as one in a million for the index.
    """
    share = lambda df, n: with_totals(df.groupBy(by).agg(F.count("*").alias("c")), df.agg(F.count("*").alias("of"))).select(by, (F.col("c") / F.col("of")).alias(n))
    both = share(left, "left_share").join(share(right, "right_share"), by, "full").na.fill(0.0)
    a, b = F.greatest("left_share", F.lit(1e-6)), F.greatest("right_share", F.lit(1e-6))
    return both.withColumn("difference", F.col("right_share") - F.col("left_share")).withColumn("l1", F.abs("difference")).withColumn("psi", F.round((b - a) * F.log(b / a), 9))


def distribution_sets(left: DataFrame, right: DataFrame, by: Sequence[Sequence[str]]) -> DataFrame:
    """distribution() over several sets of columns in one pass over both versions.

    A row for each value of each set: ``compared`` names the set's columns, joined by ``+``, columns outside it are null, and
    total_left and total_right are the rows of each version. A null value counts as one of its own. Shares of a version
    without rows are 0.
    """
    sets = [list(s) for s in by]
    columns = list(dict.fromkeys(c for s in sets for c in s))
    side = lambda df, n: df.select(*columns, F.lit(n).alias("_left"))
    both = side(left, 1).unionByName(side(right, 0))
    count = lambda n: F.count_if(F.col("_left") == n)
    apart = F.concat(*[F.grouping(c).cast("string") for c in columns])
    counted = both.groupingSets([[], *[[F.col(c) for c in s] for s in sets]], *columns).agg(count(1).alias("_a"), count(0).alias("_b"), apart.alias("_set"))
    named = {"".join("0" if c in s else "1" for c in columns): "+".join(s) for s in sets}
    totals = counted.where(F.col("_set") == "1" * len(columns)).select(F.col("_a").alias("total_left"), F.col("_b").alias("total_right"))
    compared = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])[F.col("_set")]
    # The set without columns has one row, if there are rows at all.
    out = with_totals(counted.where(F.col("_set") != "1" * len(columns)), totals.agg(*[F.max(c).alias(c) for c in ("total_left", "total_right")]))
    share = lambda n, of: F.coalesce(F.try_divide(F.col(n), F.col(of)), F.lit(0.0))
    out = out.select(compared.alias("compared"), *columns, "total_left", "total_right", share("_a", "total_left").alias("left_share"), share("_b", "total_right").alias("right_share"))
    a, b = F.greatest("left_share", F.lit(1e-6)), F.greatest("right_share", F.lit(1e-6))
    return out.withColumn("difference", F.col("right_share") - F.col("left_share")).withColumn("l1", F.abs("difference")).withColumn("psi", F.round((b - a) * F.log(b / a), 9))


def split(rows: DataFrame, key: str, shares: Sequence[tuple[str, int]] = (("train", 80), ("val", 10), ("test", 10))) -> DataFrame:
    """Rows with a split by a hash of ``key``, so that a key is always in the same one; shares are parts of 100."""
    if sum(n for _, n in shares) != 100:
        raise ValueError("shares must add up to 100")
    digits = F.substring(F.sha2(F.col(key).cast("string").cast("binary"), 256), 1, 8)
    slot, top, out = F.conv(digits, 16, 10).cast("long") % 100, 0, None
    for name, n in shares:
        top += n
        out = F.when(slot < top, name) if out is None else out.when(slot < top, name)
    return rows.withColumn("split", out)
