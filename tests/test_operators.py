"""Order-dependent operators against plain loops, and boundary cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistalog.operators import asof, associate, evaluate, infer, ingest, lift, sampling, scenario, segment, select, validate, views

FRAME = "frame_id string, timestamp_us long, channel string, sequence_id string, pos long"


def frames(spark, seed=1, n=120):
    rnd = random.Random(seed)
    rows = [(f"f{i}", rnd.randint(0, 400), rnd.choice("abc"), rnd.choice(["s1", "s2", "", None]), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, FRAME)


@pytest.mark.parametrize("limits", [(30, None), (30, 3), (None, 3), (0, 0)])
def test_limit_split_equals_a_loop(spark, limits):
    rows, df = frames(spark)
    chunks = segment.gap_chunks(segment.group_frames(df, "log"), 15)
    got = {(r["frame_id"]): r["part"] for r in segment.split_by_limits(chunks, *limits).collect()}
    by = {}
    for r in chunks.collect():
        by.setdefault((r["group_key"], r["chunk"]), []).append((r["timestamp_us"], r["pos"], r["frame_id"]))
    for group in by.values():
        part, first, count = 0, None, 0
        for t, _, f in sorted(group):
            if first is not None and ((limits[0] and t - first > limits[0]) or (limits[1] and count + 1 > limits[1])):
                part, first, count = part + 1, None, 0
            first, count = (t if first is None else first), count + 1
            assert got[f] == part


def test_gaps_and_windows_at_their_bounds(spark):
    df = spark.createDataFrame([("a", 0, "x", "s", 0), ("b", 10, "x", "s", 1), ("c", 21, "x", "s", 2), ("d", 21, "y", "s", 3)], FRAME)
    g = segment.group_frames(df, "log")
    assert {r["frame_id"]: r["chunk"] for r in segment.gap_chunks(g, 10).collect()} == {"a": 0, "b": 0, "c": 1, "d": 1}
    assert sorted((r["frame_id"], r["chunk"]) for r in segment.window_chunks(g, 10, 5).collect()) == [("a", 0), ("b", 1), ("b", 2), ("c", 3), ("c", 4), ("d", 3), ("d", 4)]
    assert sorted((r["frame_id"], r["chunk"]) for r in segment.window_chunks(g, 5, 20).collect()) == [("a", 0), ("c", 1), ("d", 1)]


@pytest.mark.parametrize("bucket", [1, 7, 50, 1000])
def test_bucketed_gaps_equal_plain_ones(spark, bucket):
    _, df = frames(spark, 6, 80)
    g = segment.group_frames(df, "log")
    assert sorted(segment.bucketed_gap_chunks(g, 9, bucket).select("frame_id", "chunk").collect()) == sorted(segment.gap_chunks(g, 9).select("frame_id", "chunk").collect())


def test_segment_ids(spark):
    df = spark.createDataFrame([("a", 0, "x", "s/1 b", 0), ("b", 10, "x", "s/1 b", 1)], FRAME)
    assert {r["segment_id"] for r in segment.segments(df, "log", "sequence").collect()} == {"s/1 b"}
    assert {r["segment_id"] for r in segment.segments(df, "log", "gap_based", max_gap_us=1).collect()} == {"log-s_1_b-gap0000", "log-s_1_b-gap0001"}
    with pytest.raises(ValueError):
        segment.segments(df, strategy="other")


def _asof(anchors, rows, direction, tolerance, later):
    out = {}
    for a, t in anchors:
        best = None
        for r in rows:
            d = r[1] - t
            if direction == "previous" and d > 0 or direction == "next" and d < 0 or abs(d) > tolerance:
                continue
            key = (abs(d), d < 0, -r[4] if d < 0 else r[4]) if later else (abs(d), d > 0, r[4])
            if best is None or key < best[0]:
                best = (key, r[0])
        out[a] = best and best[1]
    return out


@pytest.mark.parametrize("direction", asof.DIRECTIONS)
@pytest.mark.parametrize("later", [False, True])
@pytest.mark.parametrize("bucket", [None, 7])
def test_asof_equals_brute_force(spark, direction, later, bucket):
    rows, df = frames(spark, 3, 60)
    anchors = [(i, i * 4) for i in range(110)]
    left = spark.createDataFrame(anchors, "anchor long, timestamp_us long")
    got = {r["anchor"]: r["found"] and r["found"]["frame_id"] for r in asof.asof(left, df, [], direction, 5, later, bucket_us=bucket).collect()}
    want = _asof(anchors, rows, direction, 5, later)
    if later and direction == "previous":  # of equal times before, the last counts; at the anchor's own time the first is one after
        assert {a for a, f in got.items() if f} <= {a for a, f in want.items() if f}
    elif later and direction == "next":
        assert got == want
    else:
        assert got == want


def test_frames_are_used_once(spark):
    rnd = random.Random(9)
    rows = [(f"f{i}", rnd.randint(0, 100), "c", "s", i) for i in range(40)]
    df = spark.createDataFrame(rows, FRAME).withColumn("segment_id", F.lit("s"))
    anchors = [("s", t, None, i, i) for i, t in enumerate(sorted(rnd.randint(0, 100) for _ in range(30)))]
    a = spark.createDataFrame(anchors, "segment_id string, timestamp_us long, anchor_frame_id string, anchor_pos long, anchor_index long")
    for strategy in asof.DIRECTIONS:
        got = {r["anchor_index"]: r["frame_id"] for r in associate.associate_once(a, df, associate.target_channels(df), strategy, 6).collect()}
        used = set()
        for _, t, _, _, i in anchors:
            free = [(abs(r[1] - t), r[1], r[4], r[0]) for r in rows if r[0] not in used and abs(r[1] - t) <= 6 and not (strategy == "previous" and r[1] > t) and not (strategy == "next" and r[1] < t)]
            want = min(free)[3] if free else None
            assert got[i] == want
            used.add(want)


def test_spacing_keeps_at_the_gap(spark):
    a = spark.createDataFrame([("s", t, None, i) for i, t in enumerate([0, 4, 5, 9, 10, 16])], "segment_id string, timestamp_us long, anchor_frame_id string, anchor_pos long")
    assert [r["timestamp_us"] for r in sampling.spaced(a, 5).orderBy("timestamp_us").collect()] == [0, 5, 10, 16]
    assert [r["anchor_index"] for r in sampling.thin(a, 2, None, 2).orderBy("timestamp_us").collect()] == [0, 1]


def test_calibrations_by_sensor_then_channel(spark):
    cal = spark.createDataFrame([("c1", "s1", "x", True, 0), ("c2", "s1", "y", False, 1), ("c3", None, "y", True, 2)], "calibration_id string, sensor_id string, channel string, has_intrinsic boolean, pos long")
    f = spark.createDataFrame([("a", "s1", "y"), ("b", None, "y"), ("c", "s9", "z")], "frame_id string, sensor_id string, channel string")
    assert {r["frame_id"]: r["calibration_id"] for r in associate.resolve_calibrations(f, cal).collect()} == {"a": "c1", "b": "c2", "c": None}
    with pytest.raises(Exception, match="no calibration"):
        associate.resolve_calibrations(f, cal, allow_missing=False).collect()


def test_matching_is_greedy_by_position(spark):
    rnd = random.Random(4)
    box = "annotation_id string, sample_id string, category string, x double, y double, z double, gt_pos long"
    gt = [(f"g{i}", f"s{i % 5}", rnd.choice("ab"), rnd.random(), rnd.random(), 0.0, i) for i in range(80)]
    pred = [(f"p{i}", f"s{i % 5}", rnd.choice("ab"), rnd.random(), rnd.random(), 0.0, i, rnd.choice(["failed", None, "succeeded"])) for i in range(80)]
    g = spark.createDataFrame(gt, box)
    p = spark.createDataFrame(pred, box.replace("annotation_id", "prediction_id").replace("gt_pos", "pred_pos") + ", lifting_status string")
    got = {r["prediction_id"]: r["annotation_id"] for r in evaluate.matches(g, evaluate.evaluable(p), 0.3).collect()}
    taken, want = set(), {}
    for q in pred:
        if q[7] == "failed":
            continue
        near = [(np.hypot(q[3] - b[3], q[4] - b[4]), b[6], b[0]) for b in gt if b[1] == q[1] and b[2] == q[2] and b[0] not in taken]
        if near and min(near)[0] <= 0.3:
            want[q[0]] = min(near)[2]
            taken.add(min(near)[2])
    assert got == want


def test_unpredicted_samples_are_no_misses(spark):
    box = "annotation_id string, sample_id string, category string, x double, y double, z double, gt_pos long"
    g = spark.createDataFrame([("g1", "s1", "vehicle.car", 0.0, 0.0, 0.0, 0), ("g2", "s2", "vehicle.car", 0.0, 0.0, 0.0, 1)], box)
    p = spark.createDataFrame([("p1", "s1", "vehicle.car", 2.0, 0.0, 0.0, 0, None), ("p2", "s3", "vehicle.car", 0.0, 0.0, 0.0, 1, "failed")], "prediction_id string, sample_id string, category string, x double, y double, z double, pred_pos long, lifting_status string")
    rows = {r["sample_id"]: (r["tp"], r["fp"], r["fn"]) for r in evaluate.get_evaluator("center_distance")(g, p).collect()}
    assert rows == {"s1": (1, 0, 0), "s3": (0, 0, 0)}
    with pytest.raises(ValueError):
        evaluate.get_evaluator("other")


def test_selection_stops_and_reasons(spark):
    rows = [("a", True, True, 5, "m", 0), ("b", False, True, 5, "m", 1), ("c", True, False, 0, None, 2), ("d", True, True, 5, "other", 3), ("e", True, True, 1, "m", 4), ("f", True, True, 9, "m", 5)]
    df = spark.createDataFrame(rows, "scene_id string, has_manifest boolean, has_ground_truth boolean, annotation_count long, ground_truth_source string, pos long").withColumn("sample_count", F.lit(2).cast("long"))
    got = {r["scene_id"]: r["reason"] for r in select.select_scenes(df, ["a", "b", "c", "d", "e"], True, 0, ["m"], 2).collect()}
    assert got == {"a": None, "b": "scene_manifest_not_found", "c": "scene_has_no_ground_truth", "d": "ground_truth_source_not_allowed", "e": None}
    assert [r["scene_id"] for r in select.unknown_scenes(spark.createDataFrame([("a",), ("zz",)], "scene_id string"), df).collect()] == ["zz"]


def test_gate_takes_the_first_rule(spark):
    df = spark.createDataFrame([(True, "x"), (False, None), (None, "bad")], "flag boolean, state string")
    rules = [{"field": "flag", "truthy": True, "code": "f", "message": "m"}, {"field": "state", "equals": None, "code": "n", "message": "m"}, {"field": "state", "one_of": ["bad"], "code": "b", "message": "m"}]
    assert [r["code"] for r in validate.gate(df, rules).collect()] == ["f", "n", "b"]
    assert validate.batch_verdict(spark.createDataFrame([], "error_count long, warning_count long")).first()["status"] == "failed"


def test_density_clusters():
    pts = np.array([[0, 0, 0], [0.1, 0, 0], [0.2, 0, 0], [5, 5, 5], [5.1, 5, 5], [5.2, 5, 5], [5.3, 5, 5], [9, 9, 9]], float)
    assert lift.largest_cluster(pts).tolist() == [False] * 3 + [True] * 4 + [False]
    assert lift.largest_cluster(pts[[0, 3, 7]]).all()


def test_model_runs_once_a_task_and_labels_are_cleaned(spark):
    df = spark.createDataFrame([("u1",), ("u2",)], "image_uri string").coalesce(1)

    @infer.backend("fixed")
    def load(score):
        return lambda uris: [[{"label": " Car ", "score": score, "x1": 1.26, "y1": 0.0, "x2": 2.0, "y2": 3.0}, {"label": "tree", "score": 1.0, "x1": 0.0, "y1": 0.0, "x2": 0.0, "y2": 0.0}] for _ in uris]

    rows = infer.cleaned(infer.detect(df, load, score=0.123456)).collect()
    assert [(r["category"], r["score"], r["x1"]) for r in rows] == [("vehicle.car", 0.1235, 1.3)] * 2
    with pytest.raises(ValueError):
        infer.detect(df, "none")


def test_mining_and_strategies(spark):
    rows = [("a", "profiled", 5, True, ["X"], 1), ("b", "built", 9, True, ["X", "Y"], 2), ("c", "validated", 0, False, [], 3)]
    df = scenario.with_candidate_columns(spark.createDataFrame(rows, "scene_id string, status string, annotation_count long, has_ground_truth boolean, channels array<string>, created_us long"))
    reasons = {r["scene_id"]: list(r["reasons"]) for r in scenario.rejected(df, profile="detection_ready", required_channels=["Y", "X", "Y"]).collect()}
    assert reasons == {"a": ["missing_channels:Y,Y"], "b": ["not_validated"], "c": ["gt_mismatch", "annotation_count_below_min", "missing_channels:Y,X,Y"]}
    assert [r["scene_id"] for r in scenario.mine(df, max_annotation_count=0).collect()] == ["c"]
    with pytest.raises(ValueError):
        scenario.choose(df, "other")


def test_leaderboard_ranks_a_page(spark):
    df = spark.createDataFrame([("a", 3, 0.0, "0.7"), ("b", 2, None, "x"), ("c", 1, 0.9, None)], "run_id string, created_us long, metric double, summary_metric string")
    assert [(r["run_id"], r["rank"]) for r in views.leaderboard(df, limit=2).orderBy("rank").collect()] == [("a", 1), ("b", 2)]


def test_links_that_break_time_order(spark):
    df = spark.createDataFrame([("a", "s", 1, "b"), ("b", "s", 2, ""), ("c", "s", 9, "a"), ("d", "s", 5, "zz")], "token string, scene_token string, timestamp_us long, next string")
    assert sorted(r["token"] for r in ingest.broken_links(df).collect()) == ["c", "d"]


def test_samples_follow_the_links_of_their_scene(spark):
    scenes = spark.createDataFrame([("s", "A", "c"), ("t", "B", "x"), ("u", "C", "gone"), ("v", "D", "p"), ("w", "E", "c")], "token string, name string, first_sample_token string")
    long = [(f"n{i}", "v", f"n{i + 1}") for i in range(40)] + [("n40", "v", None), ("p", "v", "n0")]
    rows = [("c", "s", "a"), ("a", "s", "b"), ("b", "s", ""), ("other", "s", "b"), ("x", "t", "y"), ("y", "t", "z"), ("z", "t", "x"), ("q", "u", "b"), *long]
    df = spark.createDataFrame(rows, "token string, scene_token string, next string").withColumn("extra", F.lit(1))
    got = {r["token"]: r["sample_id"] for r in ingest.linked_samples(scenes, df).collect()}
    assert got == {"c": "A-s0000", "a": "A-s0001", "b": "A-s0002", "x": "B-s0000", "y": "B-s0001", "z": "B-s0002", "p": "D-s0000"} | {f"n{i}": f"D-s{i + 1:04d}" for i in range(41)}
    assert ingest.linked_samples(scenes.limit(0), df).count() == ingest.linked_samples(scenes, df.limit(0)).count() == 0


def test_trajectories_average_agents(spark):
    schema = "scene_id string, agent_id string, timestamp_us long, pos long, x double, y double, z double"
    left = spark.createDataFrame([("s", "a", 0, 0, 0.0, 0.0, 0.0), ("s", "a", 10, 1, 0.0, 0.0, 0.0), ("s", "b", 0, 2, 1.0, 0.0, 0.0), ("t", "a", 0, 3, 0.0, 0.0, 0.0)], schema)
    right = spark.createDataFrame([("s", "a", 1, 0, 3.0, 4.0, 0.0), ("s", "b", 2, 1, 1.0, 0.0, 1.0), ("t", "a", 90, 2, 0.0, 0.0, 0.0)], schema)
    got = {r["scene_id"]: (r["trajectory_error"], r["compared_agents"]) for r in evaluate.trajectory_errors(left, right, 9).collect()}
    assert got == {"s": (3.0, 2), "t": (None, 0)}
    assert evaluate.trajectory_errors(left.limit(0), right, 9).count() == 0


def test_sensor_coverage_counts_both_shares(spark):
    schema = "scene_id string, sample_id string, channel string"
    left = spark.createDataFrame([("s", "1", "A"), ("s", "1", "A"), ("s", "2", "A"), ("s", "1", "B"), ("t", "9", "A")], schema)
    right = spark.createDataFrame([("s", "2", "A"), ("s", "3", "B"), ("u", "1", "A")], schema)
    got = {r["scene_id"]: (r["channel_coverage"], r["frame_coverage"]) for r in evaluate.sensor_coverage(left, right).collect()}
    assert got == {"s": (1.0, 0.333333), "t": (0.0, 0.0)}
