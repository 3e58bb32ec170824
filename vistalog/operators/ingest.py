"""From a source's relational tables to scene tables: samples, annotations, frames, registries and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import written

TARGET_CHANNELS = ("CAM_FRONT", "LIDAR_TOP")
MODALITIES = ("camera", "lidar", "radar")


def modality(raw: Column, channel: Column) -> Column:
    """The declared modality if it is known, else that of the channel's prefix, else unknown."""
    declared = F.lower(F.trim(raw))
    return F.when(declared.isin(*MODALITIES), declared).when(channel.startswith("CAM"), "camera").when(channel.startswith("LIDAR"), "lidar").when(channel.startswith("RADAR"), "radar").otherwise("unknown")


def ordered_samples(scenes: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples (token, scene_token, timestamp_us) of scenes (token, name) in time order, with scene_id, frame_index and sample_id."""
    w = Window.partitionBy("scene_token").orderBy("timestamp_us", "token")
    named = samples.join(scenes.select(F.col("token").alias("scene_token"), F.col("name").alias("scene_id")), "scene_token")
    numbered = named.withColumn("frame_index", (F.row_number().over(w) - 1).cast("long"))
    return numbered.withColumn("sample_id", F.format_string("%s-s%04d", "scene_id", "frame_index"))


def broken_links(samples: DataFrame) -> DataFrame:
    """Samples whose next one is missing, of another scene or not later: there time order is not the source's order."""
    after = samples.select(F.col("token").alias("next"), F.col("timestamp_us").alias("next_us"), F.col("scene_token").alias("next_scene"))
    joined = samples.where(F.coalesce("next", F.lit("")) != "").join(after, "next", "left")
    good = (F.col("next_us") > F.col("timestamp_us")) & (F.col("next_scene") == F.col("scene_token"))
    return joined.where(~F.coalesce(good, F.lit(False))).select("token", "next")


def linked_samples(scenes: DataFrame, samples: DataFrame) -> DataFrame:
    """Samples (token, scene_token, next) of scenes (token, name, first_sample_token) in the order of the source's links.

    A sample that its scene's first one does not lead to is left out, and so is one that is not of that scene; a token
    occurs once. Links to samples that are missing, null or empty end a scene. Of several samples with one next, the one
    that the first leads to counts, and links that lead back end the scene before the first repeated sample.
    Places are found by doubling: each round follows twice as many links, in joins by token, so a scene of n samples
    takes log2(n) rounds however its samples are spread over tasks.
    """
    heads = scenes.select(F.col("token").alias("scene_token"), F.col("name").alias("scene_id"), F.col("first_sample_token"))
    own = samples.select("token", "scene_token", "next")
    target = own.select(F.col("token").alias("next"), F.col("scene_token").alias("_scene"))
    jump = written(own.join(target, "next").where(F.col("_scene") == F.col("scene_token")).select("token", F.col("next").alias("to")), "links")
    start = heads.join(samples.select(F.col("token").alias("first_sample_token"), "scene_token"), ["first_sample_token", "scene_token"])
    placed = written(start.select(F.col("first_sample_token").alias("token"), F.lit(0).cast("long").alias("frame_index")), "places")
    step = 1
    while True:
        ahead = placed.join(jump, "token").select(F.col("to").alias("token"), (F.col("frame_index") + step).alias("frame_index"))
        both = placed.union(ahead).groupBy("token").agg(F.min("frame_index").alias("frame_index"))
        grown = written(both, "places")
        if grown.count() == placed.count():
            break
        far = jump.select(F.col("token").alias("to"), F.col("to").alias("_to"))
        jump = written(jump.join(far, "to").select("token", F.col("_to").alias("to")), "links")
        placed, step = grown, 2 * step
    named = samples.join(placed, "token").join(heads.drop("first_sample_token"), "scene_token")
    return named.withColumn("sample_id", F.format_string("%s-s%04d", "scene_id", "frame_index"))


def annotations(ordered: DataFrame, boxes: DataFrame, attributes: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """Boxes of ordered samples with the names of their attributes in order; tokens of unknown attributes are left out.

    Boxes share few lists of attributes, so names are found once a list, and boxes meet them by their list. ``lists``
    (attribute_tokens) may give all lists that boxes can have, where they are cheaper to read than from ``boxes``. Runs a job
    that writes the lists' names to the shared folder, so that Spark knows their size.
    """
    keyed = boxes.join(ordered.select(F.col("token").alias("sample_token"), "scene_id", "sample_id", "timestamp_us"), "sample_token")
    each = (boxes if lists is None else lists).select("attribute_tokens").distinct()
    pairs = each.select("attribute_tokens", F.posexplode("attribute_tokens").alias("p", "attribute_token")).join(attributes.select(F.col("token").alias("attribute_token"), "name"), "attribute_token")
    names = pairs.groupBy("attribute_tokens").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "name"))), lambda s: s["name"]).alias("attributes"))
    joined = keyed.join(written(names, "attribute-lists"), "attribute_tokens", "left")
    rest = [c for c in keyed.columns if c not in ("token", "attribute_tokens")]
    return joined.select("token", *rest, F.coalesce("attributes", F.array().cast("array<string>")).alias("attributes"))


def velocities(boxes: DataFrame, max_step_us: int = 1_500_000) -> DataFrame:
    """vx, vy and vz from the neighbouring boxes of an instance, or from one of them and the box itself at an end.

    Null without a neighbour, for equal times, or if the time is over ``max_step_us``, twice that between two neighbours.
    """
    w = Window.partitionBy("instance_token").orderBy("timestamp_us", "token")
    place = F.struct("x", "y", "z", F.col("timestamp_us").alias("t"))
    out = boxes.withColumn("_me", place).withColumn("_a", F.lag("_me").over(w)).withColumn("_b", F.lead("_me").over(w))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    out = out.withColumn("_p", F.coalesce("_a", "_me")).withColumn("_q", F.coalesce("_b", "_me"))
    dt = (F.col("_q.t") - F.col("_p.t")) / 1_000_000
    good = (dt > 0) & (F.col("_q.t") - F.col("_p.t") <= F.when(both, 2 * max_step_us).otherwise(max_step_us))
    return out.select(*boxes.columns, *[F.when(good, (F.col(f"_q.{c}") - F.col(f"_p.{c}")) / dt).alias(f"v{c}") for c in ("x", "y", "z")])


def sensor_frames(ordered: DataFrame, data: DataFrame, calibrations: DataFrame, sensors: DataFrame, poses: DataFrame, channels: Sequence[str] | None = TARGET_CHANNELS) -> DataFrame:
    """Frames of ordered samples in the target channels, or in all, with calibration, sensor, pose and image size.

    An image size of 0 is unknown, and only cameras have one.
    """
    d = data if channels is None else data.where(F.col("channel").isin(*channels))
    d = d.join(ordered.select(F.col("token").alias("sample_token"), "scene_id", "sample_id"), "sample_token")
    c = calibrations.select(F.col("token").alias("calibrated_sensor_token"), "sensor_token")
    s = sensors.select(F.col("token").alias("sensor_token"), F.col("modality").alias("raw_modality"))
    p = poses.select(F.col("token").alias("ego_pose_token"), F.col("timestamp_us").alias("pose_us"))
    joined = d.join(c, "calibrated_sensor_token").join(s, "sensor_token", "left").join(p, "ego_pose_token", "left").withColumn("modality", modality(F.col("raw_modality"), F.col("channel")))
    camera = F.col("modality") == "camera"
    size = lambda n: F.when(camera, F.nullif(F.col(n), F.lit(0))).alias(n)
    return joined.select(F.col("token").alias("frame_id"), "scene_id", "sample_id", "channel", "modality", "timestamp_us", F.col("calibrated_sensor_token").alias("calibration_id"), "sensor_token", F.col("ego_pose_token").alias("ego_pose_id"), "pose_us", "filename", size("width"), size("height"))


def registry(rows: DataFrame, key: Sequence[str], last_wins: bool = True) -> DataFrame:
    """One row for each key: the last by pos, or the first."""
    order = F.col("pos").desc() if last_wins else F.col("pos").asc()
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")


def raw_log_header(frames: DataFrame) -> DataFrame:
    """Counts, sorted channels and modalities and the time span of each raw log."""
    return frames.groupBy("raw_log_id").agg(
        F.count("*").alias("frame_count"), F.countDistinct("sequence_id").alias("sequence_count"), F.sort_array(F.collect_set("channel")).alias("channels"),
        F.sort_array(F.collect_set("modality")).alias("modalities"), F.min("timestamp_us").alias("start_us"), F.max("timestamp_us").alias("end_us"),
    )


def first_sequences(frames: DataFrame, most: int | None) -> DataFrame:
    """Frames of the first sequences by their position."""
    if not most:
        return frames
    first = frames.groupBy("sequence_id").agg(F.min("pos").alias("p")).orderBy("p").limit(most)
    return frames.join(first.select("sequence_id"), "sequence_id", "left_semi")


def scene_rollup(ordered: DataFrame, frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """Counts, channels and time span of each scene, and whether it has ground truth."""
    s = ordered.groupBy("scene_id").agg(F.count("*").alias("sample_count"), F.min("timestamp_us").alias("start_us"), F.max("timestamp_us").alias("end_us"))
    f = frames.groupBy("scene_id").agg(F.count("*").alias("frame_count"), F.sort_array(F.collect_set("channel")).alias("channels"))
    a = boxes.groupBy("scene_id").agg(F.count("*").alias("annotation_count"))
    out = s.join(f, "scene_id", "left").join(a, "scene_id", "left").fillna(0, ["frame_count", "annotation_count"])
    return out.withColumn("has_ground_truth", F.col("annotation_count") > 0).withColumn("ground_truth_source", F.when(F.col("has_ground_truth"), "source"))


def ingest_totals(rollup: DataFrame) -> DataFrame:
    """Totals of an ingest job and the union of channels, in one row."""
    return rollup.agg(F.count("*").alias("scene_count"), F.sum("sample_count").alias("sample_count"), F.sum("frame_count").alias("frame_count"), F.sum("annotation_count").alias("annotation_count"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("channels")))).alias("channels"))
