"""Profiles of scenes: category histograms and coverage of calibrations, poses, intrinsics and image sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .totals import with_totals


def category_histogram(annotations: DataFrame) -> DataFrame:
    """Annotations by scene and category; a null or empty category is unknown."""
    return annotations.groupBy("scene_id", F.coalesce(F.nullif("category", F.lit("")), F.lit("unknown")).alias("category")).agg(F.count("*").alias("annotation_count"))


def _share(flag: Column) -> Column:
    return F.count_if(flag) / F.count("*")


def coverage(found: DataFrame) -> DataFrame:
    """Per scene and channel: frames whose calibration and pose resolve, and for channels with a camera frame those with
    intrinsic and image size. All shares are of all the channel's frames. ``found`` is validate.resolved()."""
    camera = F.col("modality") == "camera"
    sized = F.col("width").isNotNull() & F.col("height").isNotNull()
    only = lambda c: F.when(F.bool_or(camera), c)
    return found.groupBy("scene_id", "channel").agg(
        F.count("*").alias("frame_count"), _share(F.col("has_calibration")).alias("calibration_coverage"), _share(F.col("has_pose")).alias("ego_pose_coverage"),
        only(_share(camera & F.col("has_intrinsic"))).alias("intrinsic_coverage"), only(_share(camera & sized)).alias("image_size_coverage"),
    )


def totals(scenes: DataFrame, scene_channels: DataFrame) -> DataFrame:
    """Batch totals and the sorted union of channels, in one row."""
    counts = scenes.agg(F.count("*").alias("scene_count"), F.sum("sample_count").alias("sample_count"), F.sum("frame_count").alias("frame_count"), F.sum("annotation_count").alias("annotation_count"))
    channels = scene_channels.join(scenes.select("scene_id"), "scene_id", "left_semi").agg(F.sort_array(F.collect_set("channel")).alias("channels"))
    return with_totals(counts, channels)


def channel_profile(frames: DataFrame) -> DataFrame:
    """Scenes, samples and frames of each channel, and the share of all scenes that have it."""
    every = frames.agg(F.countDistinct("scene_id").alias("of"))
    counts = frames.groupBy("channel").agg(F.countDistinct("scene_id").alias("scene_count"), F.countDistinct("sample_id").alias("sample_count"), F.count("*").alias("frame_count"))
    return with_totals(counts, every).select("channel", "scene_count", "sample_count", "frame_count", (F.col("scene_count") / F.col("of")).alias("scene_coverage"))
