"""Reading source tables, raw logs, scene manifests, prediction files and lidar points."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from .arrays import json_array
from .ranges import lidar_points  # noqa: F401


def snake(df: DataFrame) -> DataFrame:
    """Columns renamed from camelCase."""
    return df.toDF(*[re.sub(r"(?<!^)([A-Z])", lambda m: "_" + m[1].lower(), c) for c in df.columns])


def source_tables(spark: SparkSession, root: str, scene_names: Sequence[str] | None = None, max_scenes: int | None = None, kind: str = "nuscenes", lines: bool = False, range_bytes: int | None = 64 << 20) -> dict[str, DataFrame]:
    """The relational JSON tables of a scene-structured dataset; scenes by name, and the first ``max_scenes`` in source order.

    With ``lines`` a file has a document a line; else a file is one array, and read by ranges of ``range_bytes``, or with None
    by Spark's own reader, in one task.
    """
    if kind != "nuscenes":
        raise ValueError(f"unsupported source format {kind}")
    if lines or range_bytes is None:
        out = {name: spark.read.schema(schema).json(f"{root}/{name}.json", multiLine=not lines) for name, schema in schemas.SOURCE.items()}
        scenes = out["scene"].withColumn("pos", F.monotonically_increasing_id())
    else:
        out = {name: json_array(spark, f"{root}/{name}.json", schema, range_bytes) for name, schema in schemas.SOURCE.items()}
        scenes = out["scene"].withColumn("pos", F.struct("file", "at")).drop("file", "at")
        out = {name: df.drop("file", "at") for name, df in out.items()}
    if scene_names is not None:
        scenes = scenes.where(F.col("name").isin(*scene_names))
    out["scene"] = scenes.orderBy("pos").limit(max_scenes) if max_scenes else scenes
    return out


def raw_log(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    """raw_frames, calibrations and ego_poses of raw-log documents, one a file or with ``lines`` one a line; pos is the place in the document."""
    docs = spark.read.schema(schemas.RAW_LOG).json(path, multiLine=not lines)
    part = lambda array: snake(docs.select("rawLogId", F.posexplode(array).alias("pos", "v")).select("rawLogId", F.col("pos").cast("long").alias("pos"), "v.*"))
    return {"raw_frames": part("frames"), "calibrations": part("calibrations"), "ego_poses": part("egoPoses")}


def scene_manifests(spark: SparkSession, expected: DataFrame, path: str, lines: bool = False) -> DataFrame:
    """Expected scenes (scene_id) with their manifests under ``path``; one that is missing gives has_manifest false, not an error."""
    docs = snake(spark.read.schema(schemas.SCENE).option("ignoreMissingFiles", True).json(path, multiLine=not lines))
    return expected.join(docs.withColumn("has_manifest", F.lit(True)), "scene_id", "left").withColumn("has_manifest", F.coalesce("has_manifest", F.lit(False)))


def predictions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A row for each prediction of the per-sample files, in list order; a file without sample_id or predictions is an error."""
    docs = spark.read.schema(schemas.PREDICTIONS).json(path, multiLine=not lines)
    broken = F.col("sample_id").isNull() | F.col("predictions").isNull()
    checked = docs.withColumn("predictions", F.when(broken, F.raise_error(F.lit("a prediction file lacks sample_id or predictions"))).otherwise(F.col("predictions")))
    rows = checked.select("scene_id", "sample_id", F.posexplode("predictions").alias("pred_pos", "p"))
    xyz = [F.element_at("p.translation", i + 1).alias(c) for i, c in enumerate("xyz")]
    return rows.select("scene_id", "sample_id", F.col("pred_pos").cast("long").alias("pred_pos"), "p.prediction_id", F.col("p.category_name").alias("category"), *xyz, "p.score", "p.lifting_status")


def sensor_uri(root: Column, relative: Column) -> Column:
    """file:// URI of a path under a root that is a file URI or a bare path; another scheme is an error."""
    base = F.regexp_replace(F.regexp_replace(root, "^file://", ""), "/+$", "")
    uri = F.concat(F.lit("file://"), base, F.lit("/"), relative)
    return F.when(root.rlike("^[A-Za-z][A-Za-z0-9+.-]*://") & ~root.startswith("file://"), F.raise_error(F.concat(F.lit("unsupported root "), root))).otherwise(uri)
