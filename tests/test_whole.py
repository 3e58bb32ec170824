"""Queries over whole tables, on tables that are larger than the limits of their capped forms."""

import pytest

from vistalog.plans import ingestion, registry

MIDDLE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["d6_prediction_records", "d8_scaled_boxes"])
def test_all_orders_are_detections(spark, name):
    assert registry.queries()[name](spark, MIDDLE).count() == spark.read.parquet(f"{MIDDLE}/orders.parquet").count() > 3000


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_detections_name_all_lidar_frames(spark, sf):
    d = f"/root/testdata/{sf}"
    frames = lambda view, column: {r[0] for r in ingestion._view(spark, d, view).select(column).distinct().collect()}
    assert frames("detections", "lidar_frame_id") == frames("lidar_points", "frame_id")


def test_poses_of_all_frames(spark):
    tokens = ingestion._view(spark, MIDDLE, "src_poses").count(), ingestion._view(spark, MIDDLE, "src_data").select("ego_pose_token").distinct().count()
    assert tokens == (9000, 10000)


def test_raw_log_headers_count_all_frames(spark):
    rows = registry.queries()["i6_raw_log_headers"](spark, MIDDLE).collect()
    assert sum(r["frame_count"] for r in rows) == spark.read.parquet(f"{MIDDLE}/events.parquet").count()


def test_all_scenes_get_a_verdict(spark):
    scenes = spark.read.parquet(f"{MIDDLE}/orders.parquet").count()
    assert registry.queries()["d1_scene_selection"](spark, MIDDLE).count() == scenes
    summary = registry.queries()["d2_selection_summary"](spark, MIDDLE).collect()[0]
    assert summary["inspected_count"] == summary["total_count"] == scenes and summary["selected_count"] > 1000


def test_all_samples_of_a_camera_are_selected(spark):
    lines = spark.read.parquet(f"{MIDDLE}/lineitem.parquet").where("l_returnflag = 'A'")
    assert registry.queries()["d3_samples"](spark, MIDDLE).count() == lines.select("l_orderkey", "l_linenumber").distinct().count() > 3000


def test_selected_scenes_stay_selected_in_comparisons(spark):
    chosen = registry.queries()["d1_scene_selection"](spark, MIDDLE).where("selected").select("scene_id")
    compared = registry.queries()["o8_compare"](spark, MIDDLE).where("selected").select("scene_id")
    assert chosen.exceptAll(compared).isEmpty() and compared.exceptAll(chosen).isEmpty()
