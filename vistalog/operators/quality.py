"""Quality of scenes and datasets: latest runs, readiness, selectability and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each scene and type; of equal times the smallest run_id. Runs without a scene do not count."""
    w = Window.partitionBy("scene_id", "type").orderBy(F.col("created_us").desc(), "run_id")
    return runs.where("scene_id is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def readiness() -> Column:
    """unknown, blocked, warning or ready, of a scene joined to its latest validation."""
    status = F.lower("validation_status")
    return (
        F.when(~F.col("status").isin("validated", "profiled") | F.col("run_id").isNull(), "unknown")
        .when(F.coalesce("should_block_pipeline", F.lit(False)) | status.isin("failed", "error"), "blocked")
        .when(status == "warning", "warning").when(status == "ready", "ready").otherwise("unknown")
    )


def scene_quality(scenes: DataFrame, runs: DataFrame) -> DataFrame:
    """Scenes with readiness, exclusion_reasons in order, and selectable."""
    latest = latest_runs(runs.where("type = 'scene_validation'")).select("scene_id", "run_id", "validation_status", "should_block_pipeline")
    out = scenes.join(latest, "scene_id", "left").withColumn("readiness", readiness())
    blocked = F.coalesce("should_block_pipeline", F.lit(False)) | F.lower("validation_status").isin("failed", "error")
    reasons = F.array(
        F.when(~F.col("status").isin("validated", "profiled"), "scene_not_ready"),
        F.when(F.col("run_id").isNull(), "validation_missing").when(blocked, "validation_blocked"),
        F.when(~F.coalesce("has_ground_truth", F.lit(False)) | (F.coalesce("annotation_count", F.lit(0)) <= 0), "missing_ground_truth"),
    )
    return out.withColumn("exclusion_reasons", F.array_compact(reasons)).withColumn("selectable", F.size("exclusion_reasons") == 0)


def dataset_quality(quality: DataFrame) -> DataFrame:
    """A row for each dataset version: counts by readiness, selectable scenes, ground truth, totals, readiness and coverage."""
    is_ = lambda v: F.count_if(F.col("readiness") == v)
    out = quality.groupBy("dataset_id", "dataset_version").agg(
        F.count("*").alias("scene_count"), is_("ready").alias("ready_count"), is_("warning").alias("warning_count"), is_("blocked").alias("blocked_count"), is_("unknown").alias("unknown_count"),
        F.count_if("selectable").alias("selectable_count"), F.count_if(~F.col("selectable")).alias("not_selectable_count"), F.count_if("has_ground_truth").alias("ground_truth_count"), F.count_if(F.col("annotation_count") > 0).alias("annotated_count"),
        F.sum("sample_count").alias("sample_count"), F.sum("frame_count").alias("frame_count"), F.sum("annotation_count").alias("annotation_count"),
    )
    state = (
        F.when((F.col("scene_count") == 0) | (F.col("unknown_count") == F.col("scene_count")), "unknown").when(F.col("selectable_count") == 0, "blocked")
        .when(F.col("warning_count") + F.col("blocked_count") + F.col("unknown_count") + F.col("not_selectable_count") > 0, "warning").otherwise("ready")
    )
    return out.withColumn("readiness", state).withColumn("ground_truth_coverage", F.coalesce(F.round(F.try_divide("ground_truth_count", "scene_count"), 4), F.lit(0.0)))


def exclusion_histogram(quality: DataFrame) -> DataFrame:
    return quality.select("dataset_id", F.explode("exclusion_reasons").alias("reason")).groupBy("dataset_id", "reason").agg(F.count("*").alias("scenes"))


def observed_channels(scenes: DataFrame, runs: DataFrame, scene_channels: DataFrame) -> DataFrame:
    """Sorted union of the channels of each dataset's profiled scenes."""
    profiled = runs.where("type = 'scene_profile'").select("scene_id").distinct()
    seen = scenes.select("scene_id", "dataset_id").join(profiled, "scene_id", "left_semi").join(scene_channels, "scene_id")
    return seen.groupBy("dataset_id").agg(F.sort_array(F.collect_set("channel")).alias("channels"))


def quality_page(quality: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of scenes, newest first, each with its dataset's summary over all scenes."""
    page = quality.orderBy(F.col("created_us").desc(), "scene_id").offset(offset).limit(limit)
    summary = quality.groupBy("dataset_id").agg(F.count("*").alias("all_scenes"), F.count_if("selectable").alias("all_selectable"))
    return page.join(summary, "dataset_id")
