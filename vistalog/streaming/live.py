"""Streams of frames and job events; an extension, since batch has the same operators.

Late rows: a row older than the watermark's delay behind the newest one seen is left out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def frame_stream(spark, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Frames (timestamp_us and more) from files as they come, with their time ts."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.timestamp_micros("timestamp_us"))


def live_segments(frames: DataFrame, gap: str = "500 milliseconds", delay: str = "10 seconds") -> DataFrame:
    """Segments of each sequence cut where frames are more than ``gap`` apart, given out once the watermark has passed.

    Frames exactly the gap apart are in one session window, as the batch operator has it.
    """
    marked = frames.withWatermark("ts", delay)
    out = marked.groupBy("sequence_id", F.session_window("ts", gap)).agg(F.count("*").alias("frame_count"), F.min("timestamp_us").alias("start_us"), F.max("timestamp_us").alias("end_us"))
    return out.drop("session_window")


def live_status_counts(jobs: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events by kind and status in each window of time."""
    return jobs.withWatermark("ts", delay).groupBy(F.window("ts", window), "kind", "status").agg(F.count("*").alias("n")).select(F.unix_micros("window.start").alias("start_us"), "kind", "status", "n")


class _Parts(StatefulProcessor):
    """State of one group: frames that the watermark has not passed, and the part that is open."""

    def __init__(self, gap: int, duration: int | None, most: int | None, least: int, shortest: int):
        self.gap, self.duration, self.most, self.least, self.shortest = gap, duration, most, least, shortest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "timestamp_us long")
        self.open = handle.getValueState("open", "start_us long, end_us long, frame_count long, given long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        times = [int(t) for part in rows for t in part["timestamp_us"]]
        self.waiting.appendList([(t,) for t in times])
        # Timers fire beyond their time, in milliseconds; the first frame's bounds the wait, the last one's ends it.
        for t in {min(times), max(times)}:
            self.handle.registerTimer(t // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        times = sorted(t for (t,) in self.waiting.get())
        ready, rest = [t for t in times if t <= now], [t for t in times if t > now]
        start, end, n, given = self.open.get() if self.open.exists() else (0, 0, 0, 0)
        out = []

        def finish() -> None:
            nonlocal given
            if n >= self.least and end - start >= self.shortest:
                out.append((*key, given, start, end, n))
                given += 1

        for t in ready:
            if n and (t - end > self.gap or (self.duration and t - start > self.duration) or (self.most and n >= self.most)):
                finish()
                n = 0
            start, end, n = (start if n else t), t, n + 1
        if n and end + self.gap <= now:
            finish()
            n = 0
        if ready:
            self.waiting.put([(t,) for t in rest]) if rest else self.waiting.clear()
        self.open.update((start, end, n, given))
        if rest:
            self.handle.registerTimer(rest[0] // 1000 + 1)
        if n:
            self.handle.registerTimer((end + self.gap) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=["group_key", "segment_index", "start_us", "end_us", "frame_count"])

    def close(self) -> None:
        pass


def live_parts(frames: DataFrame, max_gap_us: int = 500_000, max_duration_us: int | None = None, max_frame_count: int | None = None, min_frame_count: int = 1, min_duration_us: int = 0, delay: str = "10 seconds", default_sequence_id: str = "default") -> DataFrame:
    """Segments as the batch operators for gaps, limits and short parts give them, from frames (sequence_id, timestamp_us, ts) in any order.

    Frames wait until the watermark, ``delay`` behind the newest one, has passed them, and are then taken in the order of time; a part
    is given out when a frame begins the next one, or when none can follow it any more. Frames later than ``delay`` are left
    out. A group's state is its frames within the delay, the open part and the number of parts so far; it is kept, so that
    numbers go on. Frames without a sequence are one group. The session's state store must be RocksDB, which Spark asks for.
    """
    named = frames.withWatermark("ts", delay).select(F.coalesce(F.nullif("sequence_id", F.lit("")), F.lit(default_sequence_id)).alias("group_key"), "timestamp_us", "ts")
    parts = _Parts(max_gap_us, max_duration_us, max_frame_count, min_frame_count, min_duration_us)
    return named.groupBy("group_key").transformWithStateInPandas(parts, "group_key string, segment_index long, start_us long, end_us long, frame_count long", "append", "eventtime")
