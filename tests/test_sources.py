"""Files in and out, and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistalog.sources import readers, writers
from vistalog.streaming import live


def test_source_tables(spark, tmp_path):
    tables = {n: [] for n in ("scene", "sample", "sample_data", "sample_annotation", "calibrated_sensor", "sensor", "ego_pose", "attribute")}
    tables["scene"] = [{"token": f"t{i}", "name": f"scene-{i}", "first_sample_token": "x"} for i in range(4)]
    for n, rows in tables.items():
        (tmp_path / f"{n}.json").write_text(json.dumps(rows))
    got = readers.source_tables(spark, str(tmp_path), ["scene-3", "scene-1", "scene-2"], 2)
    assert [r["name"] for r in got["scene"].collect()] == ["scene-1", "scene-2"]
    with pytest.raises(ValueError):
        readers.source_tables(spark, str(tmp_path), kind="other")


def test_raw_log(spark, tmp_path):
    doc = {"rawLogId": "l", "frames": [{"frameId": "f1", "timestampUs": 5, "channel": "CAM_FRONT", "sequenceId": None}, {"frameId": "f2", "timestampUs": 3}], "calibrations": [{"calibrationId": "c", "translation": [0, 0, 1]}], "egoPoses": []}
    (tmp_path / "raw_log.json").write_text(json.dumps(doc))
    got = readers.raw_log(spark, str(tmp_path / "raw_log.json"))
    assert [(r["frame_id"], r["pos"], r["timestamp_us"]) for r in got["raw_frames"].orderBy("pos").collect()] == [("f1", 0, 5), ("f2", 1, 3)]
    assert got["calibrations"].first()["calibration_id"] == "c" and got["ego_poses"].count() == 0


def test_manifests_may_be_missing(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"sceneId": "a", "sampleCount": 2}))
    expected = spark.createDataFrame([("a",), ("b",)], "scene_id string")
    assert {r["scene_id"]: (r["has_manifest"], r["sample_count"]) for r in readers.scene_manifests(spark, expected, str(tmp_path)).collect()} == {"a": (True, 2), "b": (False, None)}


def test_prediction_files(spark, tmp_path):
    good = {"scene_id": "s", "sample_id": "m", "predictions": [{"prediction_id": "p0", "category_name": "c", "translation": [1.0, 2.0, 3.0], "score": 0.5}, {"prediction_id": "p1"}]}
    (tmp_path / "g.json").write_text(json.dumps(good))
    rows = readers.predictions(spark, str(tmp_path / "g.json")).orderBy("pred_pos").collect()
    assert [(r["prediction_id"], r["pred_pos"], r["y"]) for r in rows] == [("p0", 0, 2.0), ("p1", 1, None)]
    (tmp_path / "b.json").write_text(json.dumps({"scene_id": "s", "predictions": []}))
    with pytest.raises(Exception, match="lacks sample_id"):
        readers.predictions(spark, str(tmp_path / "b.json")).collect()


def test_lidar_points(spark, tmp_path):
    np.arange(20, dtype="<f4").tofile(tmp_path / "frame7.pcd.bin")
    rows = readers.lidar_points(spark, str(tmp_path)).orderBy("point_pos").collect()
    assert [(r["frame_id"], r["x"], r["y"], r["z"]) for r in rows] == [("frame7", 5.0 * i, 5.0 * i + 1, 5.0 * i + 2) for i in range(4)]


def test_uris(spark):
    df = spark.createDataFrame([("/data/raw",), ("file:///data/raw/",)], "root string")
    assert {r["u"] for r in df.select(readers.sensor_uri(F.col("root"), F.lit("a/b.jpg")).alias("u")).collect()} == {"file:///data/raw/a/b.jpg"}
    with pytest.raises(Exception, match="unsupported root"):
        spark.createDataFrame([("s3://x",)], "root string").select(readers.sensor_uri(F.col("root"), F.lit("a"))).collect()


def test_rewriting_a_version_leaves_others(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([("d", "v1", 1), ("d", "v2", 2)], "dataset_id string, dataset_version string, n long")
    writers.write_tables(one, path)
    writers.write_tables(one.where("dataset_version = 'v1'").withColumn("n", F.lit(9).cast("long")), path)
    assert sorted((r["dataset_version"], r["n"]) for r in spark.read.parquet(path).collect()) == [("v1", 9), ("v2", 2)]
    writers.reset_version(one.limit(0), path, "d", "v2")
    assert [r["n"] for r in spark.read.parquet(path).collect()] == [9]
    writers.write_documents(one.withColumnRenamed("n", "scene_count"), str(tmp_path / "j"))
    assert {json.loads(r["value"])["sceneCount"] for r in spark.read.text(str(tmp_path / "j")).collect()} == {1, 2}


def test_streamed_segments_equal_batch(spark, tmp_path):
    rows = [("s", f"f{i}", t) for i, t in enumerate([0, 400_000, 900_000, 1_400_001, 2_000_000_000])]
    df = spark.createDataFrame(rows, "sequence_id string, frame_id string, timestamp_us long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.live_segments(live.frame_stream(spark, str(tmp_path / "in"), "sequence_id string, frame_id string, timestamp_us long"))
    query = stream.writeStream.outputMode("append").format("memory").queryName("segments").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["start_us"], r["end_us"], r["frame_count"]) for r in spark.table("segments").collect()) == [(0, 900_000, 3), (1_400_001, 1_400_001, 1)]


def test_streamed_status_counts(spark, tmp_path):
    df = spark.createDataFrame([("job", "failed", 10), ("job", "failed", 20), ("job", "running", 7_200_000_001)], "kind string, status string, timestamp_us long")
    df.write.parquet(str(tmp_path / "in"))
    stream = live.live_status_counts(live.frame_stream(spark, str(tmp_path / "in"), df.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r["status"], r["n"]) for r in spark.table("counts").collect()} == {("failed", 2), ("running", 1)}
