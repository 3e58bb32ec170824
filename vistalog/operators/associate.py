"""Aligning sensors to anchors, and resolving calibrations, poses and image metadata of frames."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import mix, slerp
from .asof import DIRECTIONS, asof
from .folds import sorted_fold
from .steps import written


def target_channels(frames: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """segment_id and channel to align: the required channels, else those that the segment has."""
    if required:
        return frames.select("segment_id").distinct().withColumn("channel", F.explode(F.array(*[F.lit(c) for c in sorted(set(required))])))
    return frames.select("segment_id", "channel").distinct()


def associate(anchors: DataFrame, frames: DataFrame, targets: DataFrame, strategy: str = "nearest", tolerance_us: int = 100_000) -> DataFrame:
    """A row for each anchor and target channel, with frame_id and offset_us of the frame within tolerance, or null.

    Time buckets of ten tolerances cut long segments, so no task holds a whole one.
    """
    asks = anchors.join(targets, "segment_id")
    side = frames.select("segment_id", "channel", "timestamp_us", "pos", "frame_id")
    joined = asof(asks, side, ["segment_id", "channel"], strategy, tolerance_us, bucket_us=max(1, 10 * tolerance_us))
    return joined.withColumn("frame_id", F.col("found.frame_id")).withColumn("offset_us", F.col("found.timestamp_us") - F.col("timestamp_us")).drop("found")


def _chosen(rows: DataFrame, keys: Sequence[str], strategy: str, tolerance_us: int) -> DataFrame:
    """What anchors choose in order, each the best frame that is not used yet: the keys, _bucket, anchor_index, frame_id and frame_us.

    ``rows`` are frames (_kind 0), at the first time at which an anchor can reach them, and anchors (_kind 1). Frames stand in order of
    time, and those used are skipped by links to the nearest free one on each side, so an anchor costs about as much in a crowd as elsewhere.
    A frame that has fallen behind all that anchors can reach is forgotten, so the state is as wide as the tolerance.
    """

    def start():
        times: list[int] = []
        ids: list[str] = []
        # left[i + 1] and right[i] lead to the nearest free frame at or before, and at or after i; 0 and len(times) stand for none.
        left, right = [0], [0]
        used: set[str] = set()
        most = 1024

        def root(links: list[int], i: int) -> int:
            end = i
            while links[end] != end:
                end = links[end]
            while links[i] != end:
                links[i], i = end, links[i]
            return end

        def add(us: int, frame: str) -> None:
            times.append(us)
            ids.append(frame)
            left.append(len(times))
            right.append(len(times))

        def use(i: int) -> None:
            left[i + 1], right[i] = i, i + 1

        def forget(low: int) -> None:
            first = bisect_left(times, low)
            used.difference_update(ids[:first])
            kept = [(times[i], ids[i], left[i + 1] == i + 1) for i in range(first, len(times))]
            times.clear(), ids.clear(), left.clear(), right.clear()
            left.append(0), right.append(0)
            for us, frame, free in kept:
                add(us, frame)
                if not free:
                    use(len(times) - 1)

        def best(us: int) -> int | None:
            at, found = bisect_right(times, us), None
            if strategy != "next" and (i := root(left, at) - 1) >= 0 and us - times[i] <= tolerance_us:
                # Of frames of one time the first is the best.
                found = root(right, bisect_left(times, times[i]))
            if strategy != "previous":
                i = root(right, bisect_left(times, us) if strategy == "next" else at)
                if i < len(times) and times[i] - us <= tolerance_us and (found is None or times[i] - us < us - times[found]):
                    found = i
            return found

        def step(kind: int, at: int, us: int, frame: str | None) -> dict | None:
            nonlocal most
            if kind == 0:
                if len(times) > most:
                    forget(at - tolerance_us)
                    most = 2 * len(times) + 1024
                add(us, frame)
                return None
            while (i := best(us)) is not None:
                use(i)
                if ids[i] not in used:
                    used.add(ids[i])
                    return {"frame_id": ids[i], "frame_us": times[i]}
            return None

        return step

    folded = sorted_fold(rows, keys, ["_at", "_kind", "_n"], ["_kind", "_at", "_us", "frame_id"], start, "_found", "struct<frame_id:string,frame_us:long>")
    names = dict.fromkeys([*keys, "_bucket"])
    return folded.where("_found is not null").select(*names, F.col("_n").alias("anchor_index"), "_found.frame_id", "_found.frame_us")


def associate_once(anchors: DataFrame, frames: DataFrame, targets: DataFrame, strategy: str = "nearest", tolerance_us: int = 100_000, rounds: int = 6) -> DataFrame:
    """As associate(), but a frame serves one anchor: anchors choose in order among frames not yet used.

    The choice folds over time buckets at once, each as if the bucket before had used none of its frames; then the buckets for which
    that was wrong are folded again from what the bucket before did use, until none is. What an anchor chooses reaches
    few anchors after it, so few buckets are wrong; keys with buckets still wrong after ``rounds`` are folded whole, in order.
    A fold takes anchors and frames in order of time, not pairs of them, so its work follows their number however dense they are.
    ``anchor_index`` follows time. Runs jobs that write to the shared folder.
    """
    if strategy not in DIRECTIONS:
        raise ValueError(f"strategy must be one of {', '.join(DIRECTIONS)}")
    asks = anchors.join(targets, "segment_id")
    key, wide = ["segment_id", "channel"], 64 * max(1, tolerance_us)
    known = " and ".join(f"{c} is not null" for c in (*key, "timestamp_us"))
    bucket = lambda c: F.floor(c / wide)
    us = F.col("timestamp_us")
    asking = asks.where(known).select(*key, bucket(us).alias("_bucket"), F.lit(1).alias("_kind"), us.alias("_at"), us.alias("_us"), F.col("anchor_index").cast("long").alias("_n"), F.lit(None).cast("string").alias("frame_id"), F.lit(True).alias("_home"))
    # A frame stands in its bucket and, near a border, in the one beyond, whose anchors reach it too.
    reach = F.explode(F.sequence(bucket(us - tolerance_us), bucket(us + tolerance_us)))
    side = frames.where(known).select(*key, reach.alias("_bucket"), F.lit(0).alias("_kind"), (us - tolerance_us).alias("_at"), us.alias("_us"), F.col("pos").cast("long").alias("_n"), "frame_id", bucket(us).alias("_own"))
    rows = written(asking.unionByName(side.withColumn("_home", F.col("_bucket") == F.col("_own")).drop("_own")), "stream")
    fold = lambda df, keys: _chosen(df, keys, strategy, tolerance_us)
    chosen = written(fold(rows, [*key, "_bucket"]), "chosen")
    # What a bucket has used of the next one's frames; buckets are wider than two tolerances, so no other can.
    passed = lambda df: df.where(F.col("frame_us") >= (F.col("_bucket") + 1) * wide - tolerance_us).groupBy(*key, (F.col("_bucket") + 1).alias("_bucket")).agg(F.array_sort(F.collect_list("frame_id")).alias("_used"))
    assumed = None
    for last in (False,) * rounds + (True,):
        now = passed(chosen)
        if assumed is None:
            wrong = now
        else:
            both = now.join(assumed.withColumnRenamed("_used", "_old"), [*key, "_bucket"], "full")
            wrong = both.where(~F.col("_used").eqNullSafe(F.col("_old"))).select(*key, "_bucket", "_used")
        wrong = written(wrong.join(rows.where("_kind = 1").select(*key, "_bucket").distinct(), [*key, "_bucket"], "left_semi"), "wrong")
        if wrong.isEmpty():
            break
        if last:
            again = wrong.select(*key).distinct()
            redone = fold(rows.where("_home").join(again, key, "left_semi"), key)
            chosen = chosen.join(again, key, "left_anti").unionByName(redone)
        else:
            assumed = written(now, "assumed")
            gone = wrong.select(*key, "_bucket", F.explode("_used").alias("frame_id"))
            free = rows.join(wrong, [*key, "_bucket"], "left_semi").join(gone, [*key, "_bucket", "frame_id"], "left_anti")
            chosen = written(chosen.join(wrong, [*key, "_bucket"], "left_anti").unionByName(fold(free, [*key, "_bucket"])), "chosen")
    out = asks.join(chosen.select(*key, "anchor_index", "frame_id", "frame_us"), [*key, "anchor_index"], "left")
    return out.withColumn("offset_us", F.col("frame_us") - F.col("timestamp_us")).drop("frame_us")


def missing_channels(associated: DataFrame) -> DataFrame:
    """Samples with their frame count and the sorted target channels that found no frame."""
    lost = F.sort_array(F.collect_list(F.when(F.col("frame_id").isNull(), F.col("channel"))))
    return associated.groupBy("segment_id", "anchor_index").agg(F.min("timestamp_us").alias("timestamp_us"), F.count("frame_id").alias("frame_count"), lost.alias("missing_channels"))


def sample_id(samples: DataFrame) -> DataFrame:
    return samples.withColumn("sample_id", F.format_string("%s-sample-%06d", "segment_id", "anchor_index"))


def keeps(drop_empty: bool = True, required: Sequence[str] = ()) -> Column:
    """True for a sample that stays: not empty, and if channels are required, without one that is missing."""
    full = F.col("frame_count") > 0 if drop_empty else F.lit(True)
    return full & ~F.arrays_overlap("missing_channels", F.array(*[F.lit(c) for c in required])) if required else full


def kept_samples(samples: DataFrame, drop_empty: bool = True, required: Sequence[str] = ()) -> DataFrame:
    """The samples that stay; their numbers do too."""
    return samples.where(keeps(drop_empty, required))


def grouping_report(samples: DataFrame, drop_empty: bool = True, required: Sequence[str] = ()) -> DataFrame:
    """Per segment, in one aggregation: samples before and after, dropped, with missing channels, and frames of those kept."""
    stays = keeps(drop_empty, required)
    return samples.groupBy("segment_id").agg(
        F.count("*").alias("before"), F.count_if(stays).alias("after"), F.count_if(~stays).alias("dropped"), F.count_if(F.size("missing_channels") > 0).alias("with_missing"),
        F.coalesce(F.sum(F.when(stays, F.col("frame_count"))), F.lit(0)).alias("associated_frames"),
    )


def grouping_totals(report: DataFrame) -> DataFrame:
    """The report with a row for the whole log, whose segment_id is null."""
    names = ("before", "after", "dropped", "with_missing", "associated_frames")
    return report.rollup("segment_id").agg(*[F.sum(n).alias(n) for n in names])


def missing_by_channel(samples: DataFrame) -> DataFrame:
    """How many samples, dropped ones too, miss each channel."""
    return samples.select("segment_id", F.explode("missing_channels").alias("channel")).groupBy("segment_id", "channel").agg(F.count("*").alias("missing"))


def resolve_calibrations(frames: DataFrame, calibrations: DataFrame, allow_missing: bool = True) -> DataFrame:
    """Frames with calibration_id and has_intrinsic: by sensor_id, else by channel; of several the first listed."""
    first = lambda key: calibrations.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct("calibration_id", "has_intrinsic"), "pos").alias(f"by_{key}"))
    out = frames.join(first("sensor_id"), "sensor_id", "left").join(first("channel"), "channel", "left").withColumn("_c", F.coalesce("by_sensor_id", "by_channel"))
    if not allow_missing:
        out = out.withColumn("_c", F.when(F.col("_c").isNull(), F.raise_error(F.concat(F.lit("no calibration for frame "), "frame_id"))).otherwise(F.col("_c")))
    return out.select(*frames.columns, F.col("_c.calibration_id").alias("calibration_id"), F.col("_c.has_intrinsic").alias("has_intrinsic"))


def nearest_pose(frames: DataFrame, poses: DataFrame, tolerance_us: int = 100_000) -> DataFrame:
    """Frames with the nearest pose of the log within tolerance; of two as near the later one. Cut into time buckets."""
    return _posed(asof(frames, poses, [], "nearest", tolerance_us, later_wins=True, bucket_us=max(1, 10 * tolerance_us)))


def exact_pose(frames: DataFrame, poses: DataFrame) -> DataFrame:
    """Frames with the first pose of equal time."""
    first = poses.where("timestamp_us is not null").groupBy("timestamp_us").agg(F.min_by(F.struct(*poses.columns), "pos").alias("found"))
    return _posed(frames.join(first, "timestamp_us", "left").select(*frames.columns, "found"))


def interpolated_pose(frames: DataFrame, poses: DataFrame, tolerance_us: int = 100_000) -> DataFrame:
    """Frames with x between the poses before and after, both within tolerance, in proportion to time."""
    bucket = max(1, 10 * tolerance_us)
    before = asof(frames, poses, [], "previous", tolerance_us, bucket_us=bucket).withColumnRenamed("found", "p")
    both = asof(before, poses, [], "next", tolerance_us, bucket_us=bucket).withColumnRenamed("found", "q")
    share = (F.col("timestamp_us") - F.col("p.timestamp_us")) / F.nullif(F.col("q.timestamp_us") - F.col("p.timestamp_us"), F.lit(0))
    x = F.when(F.col("p.timestamp_us") == F.col("q.timestamp_us"), F.col("p.x")).otherwise(F.col("p.x") + share * (F.col("q.x") - F.col("p.x")))
    return both.withColumn("x", x).drop("p", "q")


def interpolated_transform(frames: DataFrame, poses: DataFrame, tolerance_us: int = 100_000) -> DataFrame:
    """Frames with translation and rotation between the poses before and after, both within tolerance.

    Translations lie on the straight line and rotations (w, x, y, z) on the shorter arc, in proportion to time; a pose of equal
    time is taken as it is, with its rotation normalised. Without a pose on each side both are null.
    """
    bucket = max(1, 10 * tolerance_us)
    before = asof(frames, poses, [], "previous", tolerance_us, bucket_us=bucket).withColumnRenamed("found", "_p")
    both = asof(before, poses, [], "next", tolerance_us, bucket_us=bucket).withColumnRenamed("found", "_q")
    share = (F.col("timestamp_us") - F.col("_p.timestamp_us")) / F.nullif(F.col("_q.timestamp_us") - F.col("_p.timestamp_us"), F.lit(0))
    both = both.withColumn("_share", F.when(F.col("_p").isNotNull() & F.col("_q").isNotNull(), F.coalesce(share, F.lit(0.0))))
    known = F.col("_share").isNotNull()
    moved = both.withColumn("translation", F.when(known, mix(F.col("_p.translation"), F.col("_q.translation"), F.col("_share"), 3)))
    return moved.withColumn("rotation", F.when(known, slerp(F.col("_p.rotation"), F.col("_q.rotation"), F.col("_share")))).drop("_p", "_q", "_share")


def _posed(joined: DataFrame) -> DataFrame:
    return joined.withColumn("ego_pose_id", F.col("found.ego_pose_id")).drop("found")


def image_metadata(frames: DataFrame) -> DataFrame:
    """image, a struct for camera frames of which width, height or format is known, else null."""
    known = (F.col("modality") == "camera") & F.coalesce(F.col("width").cast("string"), F.col("height").cast("string"), "fileformat").isNotNull()
    return frames.withColumn("image", F.when(known, F.struct("width", "height", "fileformat")))


def resolution_stats(frames: DataFrame) -> DataFrame:
    """Frames and samples without a calibration or a pose, per segment."""
    no_cal, no_pose = F.col("calibration_id").isNull(), F.col("ego_pose_id").isNull()
    return frames.groupBy("segment_id").agg(
        F.count("*").alias("frames"), F.count_if(no_cal).alias("frames_without_calibration"), F.count_if(no_pose).alias("frames_without_pose"),
        F.countDistinct(F.when(no_cal, F.col("anchor_index"))).alias("samples_without_calibration"), F.countDistinct(F.when(no_pose, F.col("anchor_index"))).alias("samples_without_pose"),
    )


def assemble(segments: DataFrame, samples: DataFrame, frames: DataFrame) -> DataFrame:
    """Scene rows: counts over kept samples, sorted channels, and the segment's bounds. ``frames`` has a row for each frame of a kept sample."""
    counted = frames.groupBy("segment_id").agg(F.count("*").alias("frame_count"), F.sort_array(F.collect_set("channel")).alias("channels"))
    n = samples.groupBy("segment_id").agg(F.count("*").alias("sample_count"))
    return segments.select("segment_id", "start_us", "end_us").join(n, "segment_id").join(counted, "segment_id", "left")


def nested(frames: DataFrame) -> DataFrame:
    """Samples with their frames as an array sorted by time and channel, for export."""
    return frames.groupBy("segment_id", "anchor_index").agg(F.array_sort(F.collect_list(F.struct(F.col("frame_us").alias("timestamp_us"), "channel", "frame_id"))).alias("frames"))


def latest_frame_per_channel(frames: DataFrame) -> DataFrame:
    """Of several frames of one channel in a sample the last by position."""
    w = Window.partitionBy("sample_id", "channel").orderBy(F.col("pos").desc())
    return frames.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
