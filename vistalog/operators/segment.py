"""Cutting raw logs into scenes: by sequence, by time gap or by window, with limits, and their numbering.

Frames have frame_id, timestamp_us, channel, sequence_id and pos, their place in the input, which breaks ties. All
time is in microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chains import chained

ORDER = ("timestamp_us", "pos")
_MARK = {"sequence": "seq", "gap_based": "gap", "fixed_window": "win"}


def group_frames(frames: DataFrame, raw_log_id: str, respect_sequence_id: bool = True, missing: str = "default", default_sequence_id: str = "default") -> DataFrame:
    """Add group_key. A null or empty sequence_id is dropped (``missing='drop'``) or mapped to the default; without respect the log is one group."""
    if missing not in ("drop", "default"):
        raise ValueError("missing must be drop or default")
    if not respect_sequence_id:
        return frames.withColumn("group_key", F.lit(raw_log_id))
    key = F.nullif(F.col("sequence_id"), F.lit(""))
    if missing == "drop":
        return frames.where(key.isNotNull()).withColumn("group_key", key)
    return frames.withColumn("group_key", F.coalesce(key, F.lit(default_sequence_id)))


def sequence_chunks(grouped: DataFrame) -> DataFrame:
    """One chunk a group."""
    return grouped.withColumn("chunk", F.lit(0).cast("long"))


def gap_chunks(grouped: DataFrame, max_gap_us: int) -> DataFrame:
    """A new chunk where the time to the frame before is strictly more than ``max_gap_us``."""
    w = Window.partitionBy("group_key").orderBy(*ORDER)
    cut = F.coalesce((F.col("timestamp_us") - F.lag("timestamp_us").over(w) > max_gap_us).cast("long"), F.lit(0).cast("long"))
    return grouped.withColumn("cut", cut).withColumn("chunk", F.sum("cut").over(w)).drop("cut")


def bucketed_gap_chunks(grouped: DataFrame, max_gap_us: int, bucket_us: int) -> DataFrame:
    """As gap_chunks(), for groups too long for one task: rows are ordered within time buckets only.

    Each bucket's first row is compared with the last time of the group's bucket before, and chunks count on from the
    cuts of earlier buckets; both come from a table of one row a bucket.
    """
    if bucket_us <= 0:
        raise ValueError("buckets must have a width")
    key = ["group_key", "_bucket"]
    in_order, by_bucket = Window.partitionBy(*key).orderBy(*ORDER), Window.partitionBy("group_key").orderBy("_bucket")
    local = grouped.withColumn("_bucket", F.floor(F.col("timestamp_us") / bucket_us)).withColumn("_cut", F.coalesce((F.col("timestamp_us") - F.lag("timestamp_us").over(in_order) > max_gap_us).cast("long"), F.lit(0)))
    ends = local.groupBy(*key).agg(F.min("timestamp_us").alias("_low"), F.max("timestamp_us").alias("_high"), F.sum("_cut").alias("_cuts"))
    first = F.coalesce((F.col("_low") - F.lag("_high").over(by_bucket) > max_gap_us).cast("long"), F.lit(0))
    offsets = ends.withColumn("_first", first).select(*key, (F.sum(F.col("_cuts") + F.col("_first")).over(by_bucket) - F.col("_cuts")).alias("_before"))
    counted = local.withColumn("_here", F.sum("_cut").over(in_order))
    return counted.join(offsets, key).withColumn("chunk", (F.col("_before") + F.col("_here")).cast("long")).select(*grouped.columns, "chunk")


def window_chunks(grouped: DataFrame, duration_us: int, stride_us: int | None = None) -> DataFrame:
    """Windows [start + k stride, + duration) from each group's first frame; a frame is in as many as hold it, or in none."""
    stride = stride_us or duration_us
    if duration_us <= 0 or stride <= 0:
        raise ValueError("duration and stride must be positive")
    first = grouped.groupBy("group_key").agg(F.min("timestamp_us").alias("first_us"))
    d = F.col("timestamp_us") - F.col("first_us")
    low = F.greatest(F.lit(0).cast("long"), F.floor((d - duration_us) / stride) + 1)
    placed = grouped.join(first, "group_key").withColumn("low", low).withColumn("high", F.floor(d / stride)).where("low <= high")
    return placed.withColumn("chunk", F.explode(F.sequence("low", "high"))).drop("first_us", "low", "high")


def split_by_limits(chunks: DataFrame, max_duration_us: int | None = None, max_frame_count: int | None = None) -> DataFrame:
    """Add part: a new one where a frame would exceed the count, or lies strictly more than the duration after the part's first.

    A count alone is a division; a duration is a path along each frame's next cut, over time buckets, so that one long
    chunk is many tasks (see chains).
    """
    if not max_duration_us and not max_frame_count:
        return chunks.withColumn("part", F.lit(0).cast("long"))
    if not max_duration_us:
        w = Window.partitionBy("group_key", "chunk").orderBy(*ORDER)
        return chunks.withColumn("part", F.floor((F.row_number().over(w) - 1) / max_frame_count))
    return chained(chunks, ["group_key", "chunk"], ORDER, max_duration_us, max_frame_count).drop("first")


def drop_short(parts: DataFrame, min_frame_count: int = 1, min_duration_us: int = 0) -> DataFrame:
    """Leave out parts with too few frames or too short a time; windows keep the partitioning by group, so there is no shuffle."""
    w = Window.partitionBy("group_key", "chunk", "part")
    marked = parts.withColumn("_n", F.count("*").over(w)).withColumn("_span", F.max("timestamp_us").over(w) - F.min("timestamp_us").over(w))
    return marked.where((F.col("_n") >= min_frame_count) & (F.col("_span") >= min_duration_us)).drop("_n", "_span")


def segment_id(raw_log_id: str, strategy: str, group_key: Column, index: Column) -> Column:
    """The raw key for a sequence's first segment, else log-group-kind and a number of four digits at least."""
    numbered = F.format_string(f"%s-%s-{_MARK[strategy]}%04d", F.lit(raw_log_id), F.translate(group_key, "/ ", "__"), index)
    return F.when(index == 0, group_key).otherwise(numbered) if strategy == "sequence" else numbered


def number_segments(parts: DataFrame, raw_log_id: str, strategy: str) -> DataFrame:
    """Frames with segment_id; numbers count the group's surviving parts."""
    by = Window.partitionBy("group_key").orderBy("chunk", "part")
    numbered = parts.withColumn("segment_index", (F.dense_rank().over(by) - 1).cast("long"))
    return numbered.withColumn("segment_id", segment_id(raw_log_id, strategy, F.col("group_key"), F.col("segment_index")))


def rollup(segmented: DataFrame) -> DataFrame:
    """A row for each segment: start and end, frames and sorted distinct channels."""
    return segmented.groupBy("segment_id", "group_key", "segment_index").agg(
        F.min("timestamp_us").alias("start_us"), F.max("timestamp_us").alias("end_us"), F.count("*").alias("frame_count"), F.sort_array(F.collect_set("channel")).alias("channels")
    )


def frames_of(segment_frames: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames of segments by id; ids without a frame are left out."""
    return segment_frames.join(frames, "frame_id")


def first_built(segments: DataFrame, samples: DataFrame, most: int | None = None) -> DataFrame:
    """Segments with a sample, the first ``most`` by start, group and index; no or zero ``most`` is no cap."""
    kept = segments.join(samples.select("segment_id").distinct(), "segment_id", "left_semi")
    return kept.orderBy("start_us", "group_key", "segment_index").limit(most) if most else kept


def segments(frames: DataFrame, raw_log_id: str = "log", strategy: str = "gap_based", max_gap_us: int = 500_000, duration_us: int = 10_000_000, stride_us: int | None = None, max_duration_us: int | None = None, max_frame_count: int | None = None, min_frame_count: int = 1, min_duration_us: int = 0, bucket_us: int | None = None, **grouping) -> DataFrame:
    """The whole chain: frames with their segment_id. ``bucket_us`` cuts very long groups for gaps by time."""
    grouped = group_frames(frames, raw_log_id, **grouping)
    if strategy == "gap_based":
        chunks = bucketed_gap_chunks(grouped, max_gap_us, bucket_us) if bucket_us else gap_chunks(grouped, max_gap_us)
    elif strategy == "fixed_window":
        chunks = window_chunks(grouped, duration_us, stride_us)
    elif strategy == "sequence":
        chunks = sequence_chunks(grouped)
    else:
        raise ValueError(f"unknown strategy {strategy}")
    parts = split_by_limits(chunks, max_duration_us, max_frame_count)
    if bucket_us is None:
        return number_segments(drop_short(parts, min_frame_count, min_duration_us), raw_log_id, strategy)
    # One table of parts says which stay and numbers them, so rows meet it in one join.
    key = ["group_key", "chunk", "part"]
    sizes = parts.groupBy(*key).agg(F.count("*").alias("_n"), (F.max("timestamp_us") - F.min("timestamp_us")).alias("_span"))
    good = sizes.where((F.col("_n") >= min_frame_count) & (F.col("_span") >= min_duration_us)).select(*key)
    index = (F.row_number().over(Window.partitionBy("group_key").orderBy("chunk", "part")) - 1).cast("long")
    named = good.withColumn("segment_index", index).withColumn("segment_id", segment_id(raw_log_id, strategy, F.col("group_key"), F.col("segment_index")))
    return parts.join(named, key)
