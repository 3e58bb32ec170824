"""Predicates from rows against plain checks, and what is refused."""

import pytest

from vistalog.operators import predicates as P
from vistalog.operators import scenario

SCENES = [
    ("s1", ["rain"], ["car"], ["CAM", "LIDAR"], 100, 200, 5, 3.0), ("s2", [], ["bus", "car"], ["CAM"], 150, 400, 1, 9.5), ("s3", None, None, [], None, None, 0, None), ("s4", ["rain", "dark"], [], ["LIDAR", "CAM", "RADAR"], 500, 900, 9, 0.0),
]
KIND = "scene_id string, tags array<string>, categories array<string>, channels array<string>, start_us long, end_us long, annotation_count long, max_speed double"
CASES = [
    ("tag", '{"tags": ["dark", "rain"]}', {"s1", "s4"}), ("tag", '{"tags": []}', {"s1", "s2", "s3", "s4"}), ("category", '{"categories": ["bus"]}', {"s2"}), ("sensor_channel", '{"required_channels": ["CAM", "LIDAR"]}', {"s1", "s4"}),
    ("sensor_channel", "{}", {"s1", "s2", "s3", "s4"}), ("time_range", '{"start_timestamp_us": 200, "end_timestamp_us": 500}', {"s1", "s2", "s4"}), ("time_range", '{"end_timestamp_us": 120}', {"s1"}),
    ("object_count", '{"min_count": 1, "max_count": 5}', {"s1", "s2"}), ("object_count", '{"category": "car", "min_count": 2}', {"s1"}), ("object_count", '{"category": "it\'s", "max_count": 0}', {"s1", "s2", "s3"}),
    ("ego_speed", '{"max_speed_mps": 3}', {"s1", "s4"}), ("custom", '{"expression": "annotation_count % 2 = 1"}', {"s1", "s2", "s4"}), ("custom", '{"expression": "max_speed > 100 or null"}', set()),
]


@pytest.fixture(scope="module")
def tables(spark):
    boxes = [("s1", "car"), ("s1", "car"), ("s2", "car"), ("s4", "it's"), ("s1", None), ("zz", "car")]
    return spark.createDataFrame(SCENES, KIND), spark.createDataFrame(boxes, "scene_id string, category string")


def test_each_type(spark, tables):
    rows = [(f"d{i:02d}", "p", kind, params, None, None) for i, (kind, params, _) in enumerate(CASES)]
    found = P.from_rows(spark.createDataFrame(rows, "definition_id string, predicate_id string, type string, params string, weight double, enabled boolean"))
    out = P.evaluate(*tables, found, ["annotation_count", "max_speed"]).collect()
    assert len(out) == len(CASES) * len(SCENES)
    for i, (_, _, want) in enumerate(CASES):
        own = [r for r in out if r["definition_id"] == f"d{i:02d}"]
        assert {r["scene_id"] for r in own if r["passes"]} == want, CASES[i]
        assert all(r["score"] == float(r["passes"]) and r["matched"] == ["p"] * r["passes"] and r["failed"] == ["p"] * (not r["passes"]) for r in own)


def test_weights_and_disabled(tables):
    own = [P.Predicate("d", "a", "object_count", {"min_count": 5}, 3.0), P.Predicate("d", "b", "tag", {"tags": ["rain"]}, 1.0), P.Predicate("d", "c", "tag", {"tags": ["none"]}, 9.0, False), P.Predicate("e", "x", "tag", {"tags": ["none"]}, 1.0, False), P.Predicate("f", "y", "tag", {"tags": ["rain"]}, 0.0)]
    got = {(r["definition_id"], r["scene_id"]): (r["score"], r["passes"], r["matched"], r["failed"]) for r in P.evaluate(*tables, own).collect()}
    assert got["d", "s1"] == (1.0, True, ["a", "b"], []) and got["d", "s2"] == (0.0, False, [], ["a", "b"]) and got["d", "s4"][0] == 1.0
    assert got["e", "s3"] == (1.0, True, [], []) and got["f", "s1"][0] == 1.0 and got["f", "s2"][0] == 0.0
    assert P.evaluate(*tables, []).collect() == []


def test_what_is_refused(spark, tables):
    for kind, params in (("other", {}), ("tag", {"categories": []})):
        with pytest.raises(ValueError):
            P.Predicate("d", "p", kind, params)
    with pytest.raises(ValueError, match="negative"):
        P.Predicate("d", "p", "tag", {}, -1.0)
    for text in ("max_speed > 1", "annotation_count", "count(*) > 1", "annotation_count in (select 1)", None):
        with pytest.raises(Exception):
            P.evaluate(*tables, [P.Predicate("d", "p", "custom", {"expression": text})], ["annotation_count"]).collect()
    rows = spark.range(5).selectExpr("cast(id as string) as definition_id", "'p' as predicate_id", "'tag' as type", "null as params", "1.0 as weight", "true as enabled")
    with pytest.raises(ValueError, match="more than 4"):
        P.from_rows(rows, 4)


def test_speed_has_all_axes(spark):
    poses = spark.createDataFrame([("s", 0, 0.0, 0.0, 0.0, 0), ("s", 1_000_000, 3.0, 4.0, 0.0, 1), ("s", 2_000_000, 3.0, 4.0, -12.0, 2), ("s", 2_000_000, 9.0, 9.0, 9.0, 3)], "scene_id string, timestamp_us long, x double, y double, z double, pos long")
    assert [r["max_speed"] for r in scenario.ego_speed(poses).collect()] == [12.0]
    assert [r["max_speed"] for r in scenario.ego_speed(poses.drop("y", "z")).collect()] == [3.0]
