"""As-of joins with tolerance: running windows over the union of both sides, linear in the rows of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIRECTIONS = ("nearest", "previous", "next")


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], direction: str = "nearest", tolerance_us: int | None = None, later_wins: bool = False, time: str = "timestamp_us", order: str = "pos", bucket_us: int | None = None) -> DataFrame:
    """Rows of ``left`` with ``found``, a struct of the matching row of ``right``, or null.

    Of equal times on the right the first by ``order`` counts. Nearest ties go to the earlier row, or with ``later_wins``
    to the later; then a row of equal time is one after, and of equal earlier times the last counts. A match needs
    a distance of at most ``tolerance_us``. Where keys alone leave huge groups, ``bucket_us`` of at least the tolerance
    cuts them by time: right rows are copied into the buckets that they can reach.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}")
    keys, own = list(keys), [c for c in left.columns]
    value = F.struct(*[F.col(c) for c in right.columns if c not in keys])
    a = left.select(*keys, F.col(time).alias("_t"), F.struct(*own).alias("_left"))
    b = right.where(F.col(time).isNotNull()).select(*keys, F.col(time).alias("_t"), F.col(order).alias("_o"), value.alias("_right"))
    if bucket_us:
        if tolerance_us is None or bucket_us < tolerance_us:
            raise ValueError("buckets need a tolerance, and at least its width")
        slot = lambda c: F.floor(c / bucket_us)
        a = a.withColumn("_slot", slot(F.col("_t")))
        b = b.withColumn("_slot", F.explode(F.sequence(slot(F.col("_t") - tolerance_us), slot(F.col("_t") + tolerance_us))))
        keys = [*keys, "_slot"]
    both = a.withColumn("_o", F.lit(None).cast(right.schema[order].dataType)).withColumn("_right", F.lit(None).cast(b.schema["_right"].dataType)).withColumn("_ask", F.lit(True))
    both = both.unionByName(b.withColumn("_left", F.lit(None).cast(a.schema["_left"].dataType)).withColumn("_ask", F.lit(False)))
    running = lambda *by: Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ask = F.col("_ask").cast("int")
    back = F.when(~F.col("_ask"), F.struct("_t", F.col("_o") if later_wins else (-F.col("_o")).alias("_o"), "_right"))
    ahead = F.when(~F.col("_ask"), F.struct("_t", "_o", "_right"))
    both = both.withColumn("_before", F.max_by(back, F.when(~F.col("_ask"), F.struct(back["_t"], back["_o"]))).over(running(F.col("_t"), -ask if later_wins else ask)))
    both = both.withColumn("_after", F.min_by(ahead, F.when(~F.col("_ask"), F.struct(ahead["_t"], ahead["_o"]))).over(running(F.col("_t").desc(), ask)))
    gone, to = F.col("_t") - F.col("_before._t"), F.col("_after._t") - F.col("_t")
    if direction == "previous":
        first = F.col("_before")
    elif direction == "next":
        first = F.col("_after")
    else:
        nearer = to <= gone if later_wins else to < gone
        first = F.when(F.col("_before").isNull() | nearer, F.col("_after")).otherwise(F.col("_before"))
    both = both.where("_ask").withColumn("_found", first)
    if tolerance_us is not None:
        both = both.withColumn("_found", F.when(F.abs(F.col("_found._t") - F.col("_t")) <= tolerance_us, F.col("_found")))
    return both.select("_left.*", F.col("_found._right").alias("found"))
