"""The catalog of scenes and runs: registration, listings, manifests, status and lineage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def register(existing: DataFrame, built: DataFrame, key: Sequence[str] = ("scene_id",), replace_existing: bool = False) -> DataFrame:
    """The catalog with new scenes; those that exist stay, or give way with ``replace_existing``."""
    keys = list(key)
    if replace_existing:
        return existing.join(built, keys, "left_anti").unionByName(built)
    return existing.unionByName(built.join(existing, keys, "left_anti"))


def listing(df: DataFrame, filters: Mapping[str, object] | None = None, order: str = "created_us", ascending: bool = False, id_column: str | None = None, limit: int | None = 100, offset: int = 0) -> DataFrame:
    """Rows that equal all given filters, newest first (or oldest), with the id to break ties, and a page of them."""
    for column, value in (filters or {}).items():
        if value is not None:
            df = df.where(F.col(column) == value)
    out = df.orderBy(F.col(order).asc() if ascending else F.col(order).desc(), *[id_column] * bool(id_column)).offset(offset)
    return out if limit is None else out.limit(limit)


def scene_index(scenes: DataFrame, manifests: DataFrame) -> DataFrame:
    """Registered scenes whose manifest can be read."""
    return scenes.join(manifests.select("scene_id").distinct(), "scene_id", "left_semi")


def dataset_manifest(scenes: DataFrame, scene_channels: DataFrame) -> DataFrame:
    """Totals and the sorted channel union of each dataset version over all its scenes."""
    key = ["dataset_id", "dataset_version"]
    totals = scenes.groupBy(*key).agg(F.count("*").alias("scene_count"), F.sum("sample_count").alias("sample_count"), F.sum("frame_count").alias("frame_count"))
    channels = scenes.select("scene_id", *key).join(scene_channels, "scene_id").groupBy(*key).agg(F.sort_array(F.collect_set("channel")).alias("channels"))
    return totals.join(channels, key, "left").withColumn("status", F.lit("ready"))


def with_status(scenes: DataFrame, runs: DataFrame) -> DataFrame:
    """Scenes with the status that their newest run sets: a validation validated or failed, a profile profiled."""
    sets = F.when(F.col("type") == "scene_profile", "profiled").when(F.lower("validation_status").isin("failed", "error") | F.col("should_block_pipeline"), "failed").otherwise("validated")
    last = runs.where("scene_id is not null").groupBy("scene_id").agg(F.max(F.struct("created_us", "run_id", sets.alias("new"))).alias("r"))
    return scenes.join(last, "scene_id", "left").withColumn("status", F.coalesce("r.new", "status")).drop("r")


def patched(rows: DataFrame, patch: DataFrame, key: Sequence[str]) -> DataFrame:
    """``rows`` with the patch's values where these are not null; columns keep their order."""
    keys = list(key)
    fresh = patch.select(*keys, *[F.col(c).alias(f"_{c}") for c in patch.columns if c not in keys])
    return rows.join(fresh, keys, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in patch.columns and c not in keys else F.col(c) for c in rows.columns])


def lineage(artifacts: DataFrame, runs: DataFrame) -> DataFrame:
    """Artifacts with the run that made them."""
    return artifacts.join(runs, "run_id", "left")
