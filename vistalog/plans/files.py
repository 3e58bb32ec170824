"""Queries over files: views of the given tables written out in each source's format and read back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators.steps import folder
from ..sources import readers as R
from ..sources import writers as W
from ..sources.arrays import json_array
from ..sources.ranges import lidar_points, write_lidar_points
from ..sources.snapshots import Snapshots
from .adapters import ctes, table, view


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with the fields of ``schema`` that it has; documents leave the others out."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields if f.name in df.columns])


def s1_source_tables(spark, d):
    root, events = folder(spark, "source"), table(spark, d, "events")
    token = lambda c: F.col(c).cast("string")
    tables = {
        "scene": events.select(token("user_id").alias("token"), F.concat(F.lit("scene-"), token("user_id")).alias("name")).distinct(),
        "sample": events.select(token("event_id").alias("token"), token("user_id").alias("scene_token"), F.expr("unix_micros(cast(ts as timestamp))").alias("timestamp")),
        "sensor": events.select(F.col("event_type").alias("token"), F.upper("event_type").alias("channel")).distinct(),
    }
    for name, schema in schemas.SOURCE.items():
        rows = tables.get(name, events.limit(0).select(token("event_id").alias("token")))
        _shaped(rows, schema).write.json(f"{root}/{name}.json")
    got = R.source_tables(spark, root, lines=True)
    return got["sample"].join(got["scene"].select(F.col("token").alias("scene_token"), "name"), "scene_token").select("token", "name", F.col("timestamp").alias("timestamp_us"))


S1 = "select cast(event_id as varchar) as token, 'scene-' || cast(user_id as varchar) as name, epoch_us(ts) as timestamp_us from events"


def s2_raw_log(spark, d):
    """Documents of a hundred frames each."""
    path = folder(spark, "raw-log")
    frame = F.struct(F.col("frame_id").alias("frameId"), F.col("timestamp_us").alias("timestampUs"), "channel", "modality", "uri", F.col("sequence_id").alias("sequenceId"), F.col("sensor_id").alias("sensorId"))
    logs = view(spark, d, "raw_frames").withColumn("rawLogId", F.concat(F.lit("log-"), F.floor(F.col("pos") / 100).cast("string")))
    docs = logs.groupBy("rawLogId").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", frame.alias("f")))), lambda s: s["f"]).alias("frames"))
    docs.write.json(path)
    return R.raw_log(spark, path, lines=True)["raw_frames"].select("raw_log_id", "pos", "frame_id", "timestamp_us", "channel", "modality", "sequence_id", "sensor_id")


S2 = f"""with {ctes('raw_frames')}, n as (select *, 'log-' || cast(cast(floor(pos / 100.0) as bigint) as varchar) as raw_log_id from raw_frames)
select raw_log_id, row_number() over (partition by raw_log_id order by pos) - 1 as pos, frame_id, timestamp_us, channel, modality, sequence_id, sensor_id from n"""


def _scenes(spark, d):
    return view(spark, d, "scenes").select("dataset_id", "dataset_version", "scene_id", "sample_count", "frame_count", "annotation_count", "has_ground_truth")


def s3_scene_manifests(spark, d):
    path, scenes = folder(spark, "manifests"), _scenes(spark, d)
    W.write_documents(scenes.where("sample_count > 0"), path)
    return R.scene_manifests(spark, scenes.select("scene_id"), path, lines=True).select("scene_id", "has_manifest", "sample_count", "annotation_count")


S3 = f"with {ctes('scenes')} select scene_id, sample_count > 0 as has_manifest, case when sample_count > 0 then sample_count end as sample_count, case when sample_count > 0 then annotation_count end as annotation_count from scenes"


def s4_predictions(spark, d):
    path = folder(spark, "predictions")
    one = F.struct("prediction_id", F.col("category").alias("category_name"), F.array("x", "y", "z").alias("translation"), "lifting_status")
    rows = view(spark, d, "predictions").groupBy("scene_id", "sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pred_pos", one.alias("p")))), lambda s: s["p"]).alias("predictions"))
    rows.write.json(path)
    return R.predictions(spark, path, lines=True).select("scene_id", "sample_id", "pred_pos", "prediction_id", "category", "lifting_status", *[F.round(c, 6).alias(c) for c in "xyz"])


S4 = f"""with {ctes('predictions')} select scene_id, sample_id, row_number() over (partition by sample_id order by pred_pos) - 1 as pos_in, prediction_id, category, lifting_status, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z from predictions""".replace("pos_in", "pred_pos")


def s7_written_tables(spark, d):
    path = folder(spark, "tables")
    W.write_tables(_scenes(spark, d), path)
    return spark.read.parquet(path).select(*_scenes(spark, d).columns)


S7 = f"with {ctes('scenes')} select dataset_id, dataset_version, scene_id, sample_count, frame_count, annotation_count, has_ground_truth from scenes"


def s8_reset_version(spark, d):
    path, scenes = folder(spark, "versions"), _scenes(spark, d)
    W.write_tables(scenes, path)
    W.reset_version(scenes.where("annotation_count > 0"), path, "ds-1", "v1")
    return spark.read.parquet(path).select(*scenes.columns)


def s1_split_arrays(spark, d):
    """Files that are one array each, and one trailing mark, read by ranges far smaller than a file: three files, and more beyond half a million frames."""
    path = folder(spark, "arrays")
    kind = "token string, note struct<text:string,list:array<string>>, size long"
    note = F.struct(F.concat(F.lit('a "quoted" [\\] {'), "channel", F.lit("},")).alias("text"), F.array("frame_id", F.lit('\\"]')).alias("list"))
    frames = view(spark, d, "raw_frames")
    rows = frames.select(F.col("frame_id").alias("token"), note.alias("note"), F.col("timestamp_us").alias("size"))
    lines = rows.select(F.to_json(F.struct("*")).alias("value")).repartition(max(3, frames.count() // 200_000), "value")

    def bracketed(batches):
        held = None
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if not texts:
                continue
            now = ["[" + texts[0] if held is None else held, *(texts[1:] if held is None else texts)]
            held = now.pop()
            yield pa.RecordBatch.from_arrays([pa.array(now, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array([("[" if held is None else held) + "]"])], ["value"])

    lines.mapInArrow(bracketed, "value string").write.option("lineSep", ",").text(path)
    return json_array(spark, path, kind, 100_000).select("token", F.col("note.text").alias("text"), F.col("note.list")[1].alias("second"), "size")


def s8_snapshots(spark, d):
    """Versions behind a manifest: all scenes, one version reset, another kept as it was, and a staged run that is never committed."""
    scenes = _scenes(spark, d)
    store = Snapshots(spark, folder(spark, "snapshots"))
    store.write(scenes)
    store.reset(scenes.where("annotation_count > 0"), "ds-1", "v1")
    store.write(scenes.where("dataset_id = 'ds-2'").withColumn("annotation_count", F.lit(-1).cast("long")), policy="keep")
    store.stage(scenes.withColumn("sample_count", F.lit(-1).cast("long")))
    return store.read(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scenes.schema.fields))


S1A = rf"""with {ctes('raw_frames')} select frame_id as token, 'a "quoted" [\] {{' || channel || '}},' as text, '\"]' as second, timestamp_us as size from raw_frames"""


def s6_lidar_points(spark, d):
    """Embeddings as sweeps of points, written as binary files and read again by ranges smaller than a file."""
    path = folder(spark, "lidar")
    rows = table(spark, d, "embeddings").select(F.concat(F.lit("sweep"), (F.col("vec_id") % 7).cast("string")).alias("frame_id"), "vec_id", F.posexplode("embedding").alias("k", "v"))
    points = rows.where("k % 3 = 0").select("frame_id", (F.col("vec_id") * 100 + F.col("k")).alias("point_pos"), F.col("v").cast("double").alias("x"), F.col("k").cast("double").alias("y"), (F.col("vec_id") % 1000).cast("double").alias("z"))
    write_lidar_points(points, path)
    return lidar_points(spark, path, 50_000).select("frame_id", "point_pos", F.round("x", 6).alias("x"), "y", "z")


S6 = """with p as (select 'sweep' || cast(vec_id % 7 as varchar) as frame_id, vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as k from embeddings)
select frame_id, row_number() over (partition by frame_id order by vec_id * 100 + k) - 1 as point_pos, round(cast(v as double), 6) as x, cast(k as double) as y, cast(vec_id % 1000 as double) as z from p where k % 3 = 0"""


QUERIES = {
    "s1_split_arrays": (s1_split_arrays, S1A),
    "s6_lidar_points": (s6_lidar_points, S6),
    "s1_source_tables": (s1_source_tables, S1),
    "s2_raw_log": (s2_raw_log, S2),
    "s3_scene_manifests": (s3_scene_manifests, S3),
    "s4_predictions": (s4_predictions, S4),
    "s7_written_tables": (s7_written_tables, S7),
    "s8_snapshots": (s8_snapshots, f"{S7} where dataset_id <> 'ds-1' or annotation_count > 0"),
    "s8_reset_version": (s8_reset_version, f"{S7} where dataset_id <> 'ds-1' or annotation_count > 0"),
}
