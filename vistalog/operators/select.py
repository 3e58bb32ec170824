"""Choosing scenes and samples for detection runs, and admission checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .totals import with_totals


def select_scenes(scenes: DataFrame, requested: Sequence[str] | None = None, ground_truth: bool = True, min_annotation_count: int = 1, sources: Sequence[str] | None = None, max_scenes: int | None = None) -> DataFrame:
    """Scenes in manifest order (pos) with selected and the reason why not; after ``max_scenes`` selected none is judged.

    A scene whose manifest is missing has has_manifest false. A least annotation count of 0 counts as 1.
    """
    annotated = F.coalesce("has_ground_truth", F.lit(False)) & (F.coalesce("annotation_count", F.lit(0)) >= max(1, min_annotation_count))
    reason: Column = F.lit(None).cast("string")
    if sources:
        reason = F.when(~F.coalesce(F.col("ground_truth_source").isin(*sources), F.lit(False)), "ground_truth_source_not_allowed")
    if ground_truth:
        reason = F.when(~annotated, "scene_has_no_ground_truth").otherwise(reason)
    reason = F.when(~F.col("has_manifest"), "scene_manifest_not_found").otherwise(reason)
    if requested is not None:
        reason = F.when(~F.col("scene_id").isin(*requested), "not_in_requested_scene_ids").otherwise(reason)
    out = scenes.withColumn("reason", reason).withColumn("selected", F.col("reason").isNull())
    if max_scenes is None:
        return out
    last = out.where("selected").select("pos").orderBy("pos").limit(max_scenes).agg(F.count("*").alias("_n"), F.max("pos").alias("_last"))
    return with_totals(out, last).where((F.col("_n") < max_scenes) | (F.col("pos") <= F.col("_last"))).drop("_n", "_last")


def selection_summary(selection: DataFrame, total: DataFrame, listed: int = 100) -> DataFrame:
    """Counts of a selection, with the first skipped scenes by position; the count of skipped ones is whole.

    ``total`` is one row with total_count, the number of all scenes.
    """
    pick = F.col("selected")
    skipped = selection.where(~pick).orderBy("pos").limit(listed).agg(F.array_sort(F.collect_list(F.struct("pos", "scene_id", "reason"))).alias("skipped"))
    counts = selection.agg(
        F.count_if(pick).alias("selected_count"), F.count_if(~pick).alias("skipped_count"), F.count("*").alias("inspected_count"),
        F.coalesce(F.sum(F.when(pick, F.col("sample_count"))), F.lit(0)).alias("sample_count"), F.coalesce(F.sum(F.when(pick, F.col("annotation_count"))), F.lit(0)).alias("annotation_count"),
    )
    return with_totals(with_totals(counts, total.select("total_count")), skipped).select(*counts.columns, "total_count", F.transform("skipped", lambda s: s["scene_id"]).alias("skipped_scene_ids"))


def unknown_scenes(requested: DataFrame, scenes: DataFrame) -> DataFrame:
    """Requested scene ids that do not exist; a run with any must fail."""
    return requested.join(scenes.select("scene_id"), "scene_id", "left_anti")


def select_samples(frames: DataFrame, camera_channel: str, lidar: bool = False, max_samples: int | None = None) -> DataFrame:
    """Samples with a frame of the camera channel, and with ``lidar`` their LIDAR_TOP frame, in order of scene_pos and sample_pos.

    Of several frames of a channel in one sample the last by pos counts.
    """
    last = lambda channel, name: frames.where(F.col("channel") == channel).groupBy("scene_id", "sample_id").agg(F.max(F.struct("pos", "frame_id"))["frame_id"].alias(name), F.min("scene_pos").alias("scene_pos"), F.min("sample_pos").alias("sample_pos"))
    out = last(camera_channel, "camera_frame_id")
    if lidar:
        out = out.join(last("LIDAR_TOP", "lidar_frame_id").select("scene_id", "sample_id", "lidar_frame_id"), ["scene_id", "sample_id"], "left")
    return out.orderBy("scene_pos", "sample_pos").limit(max_samples) if max_samples else out


def first_samples(samples: DataFrame, max_samples: int) -> DataFrame:
    """The first samples of a dataset in manifest order."""
    return samples.orderBy("scene_pos", "sample_pos").limit(max_samples)


def admission_errors(requests: DataFrame, versions: DataFrame, models: DataFrame) -> DataFrame:
    """request_id and code of each check a run request fails: version ready with a manifest, model known and of the right backend."""
    v = versions.select("dataset_id", "dataset_version", F.col("status").alias("v_status"), "manifest_uri")
    m = models.select("model_version_id", F.col("backend").alias("m_backend"))
    joined = requests.join(v, ["dataset_id", "dataset_version"], "left").join(m, "model_version_id", "left")
    codes = F.array(
        F.when(F.col("v_status").isNull(), "dataset_version_not_found").when(F.col("v_status") != "ready", "dataset_version_not_ready").when(F.col("manifest_uri").isNull(), "dataset_manifest_missing"),
        F.when(F.col("m_backend").isNull(), "model_version_not_found").when(F.col("m_backend") != F.col("backend"), "model_backend_mismatch"),
    )
    return joined.select("request_id", F.explode(F.array_compact(codes)).alias("code"))
