"""Sample anchors: the times of a segment at which sensors are aligned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chains import chained

_ORDER = ("timestamp_us", "anchor_pos")


def channel_anchors(frames: DataFrame, channel: str = "LIDAR_TOP") -> DataFrame:
    """An anchor for each frame of ``channel``; in a segment without one every frame is an anchor."""
    has = F.max(F.col("channel") == channel).over(Window.partitionBy("segment_id"))
    marked = frames.withColumn("_has", has).where(~F.col("_has") | (F.col("channel") == channel))
    return marked.select("segment_id", "timestamp_us", F.col("frame_id").alias("anchor_frame_id"), F.col("pos").alias("anchor_pos"))


def interval_anchors(segments: DataFrame, interval_us: int) -> DataFrame:
    """Anchors at start, start + interval, up to the end of each segment, without a frame."""
    if interval_us <= 0:
        raise ValueError("the interval must be positive")
    times = F.sequence("start_us", "end_us", F.lit(interval_us).cast("long"))
    return segments.select("segment_id", F.posexplode(times).alias("anchor_pos", "timestamp_us")).select("segment_id", "timestamp_us", F.lit(None).cast("string").alias("anchor_frame_id"), F.col("anchor_pos").cast("long").alias("anchor_pos"))


def _number(anchors: DataFrame) -> DataFrame:
    return anchors.withColumn("anchor_index", (F.row_number().over(Window.partitionBy("segment_id").orderBy(*_ORDER)) - 1).cast("long"))


def every_nth(anchors: DataFrame, n: int) -> DataFrame:
    """Every n-th anchor of a segment, the first included."""
    return anchors if n <= 1 else _number(anchors).where(F.col("anchor_index") % n == 0).drop("anchor_index")


def spaced(anchors: DataFrame, gap_us: int | None) -> DataFrame:
    """Keep an anchor that is the first or at least ``gap_us`` after the last one kept: a path over time buckets (see chains)."""
    if not gap_us:
        return anchors
    return chained(anchors, ["segment_id"], _ORDER, gap_us - 1).where("first").drop("first", "part")


def capped(anchors: DataFrame, most: int | None) -> DataFrame:
    """The first ``most`` anchors of a segment, numbered from 0."""
    numbered = _number(anchors)
    return numbered.where(F.col("anchor_index") < most) if most else numbered


def thin(anchors: DataFrame, nth: int = 1, gap_us: int | None = None, most: int | None = None) -> DataFrame:
    """Every n-th, then spaced, then capped and numbered."""
    return capped(spaced(every_nth(anchors, nth), gap_us), most)
