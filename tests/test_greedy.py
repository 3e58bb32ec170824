"""Greedy choices in parallel against plain loops, and boxes by image cells against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistalog.operators import asof, associate, evaluate, lift

FRAME = "frame_id string, timestamp_us long, channel string, pos long, segment_id string"


def once(anchors, frames, strategy, tolerance):
    used, out = set(), {}
    for index, t in anchors:
        free = [(abs(u - t), u, pos, f) for f, u, pos in frames if f not in used and abs(u - t) <= tolerance and not (strategy == "previous" and u > t) and not (strategy == "next" and u < t)]
        out[index] = min(free)[3] if free else None
        used.add(out[index])
    return out


@pytest.mark.parametrize("strategy", asof.DIRECTIONS)
@pytest.mark.parametrize("span, rounds", [(3000, 6), (900, 1), (900, 0)])
def test_frames_once_over_many_buckets(spark, strategy, span, rounds):
    rnd = random.Random(span + rounds)
    frames = {s: [(f"{s}{i}", rnd.randint(0, span), i) for i in range(300)] for s in "ab"}
    anchors = {s: list(enumerate(sorted(rnd.randint(0, span) for _ in range(280)))) for s in "ab"}
    df = spark.createDataFrame([(f, t, "c", p, s) for s in "ab" for f, t, p in frames[s]], FRAME)
    a = spark.createDataFrame([(s, t, None, i, i) for s in "ab" for i, t in anchors[s]], "segment_id string, timestamp_us long, anchor_frame_id string, anchor_pos long, anchor_index long")
    out = associate.associate_once(a, df, associate.target_channels(df), strategy, 4, rounds)
    got = {(r["segment_id"], r["anchor_index"]): r["frame_id"] for r in out.collect()}
    assert got == {(s, i): f for s in "ab" for i, f in once(anchors[s], frames[s], strategy, 4).items()}


def test_a_chain_through_all_buckets_is_settled(spark):
    frames = [(f"f{i}", i, i) for i in range(-1, 500)]
    anchors = list(enumerate(range(500)))
    df = spark.createDataFrame([(f, t, "c", p, "s") for f, t, p in frames], FRAME)
    a = spark.createDataFrame([("s", t, None, i, i) for i, t in anchors], "segment_id string, timestamp_us long, anchor_frame_id string, anchor_pos long, anchor_index long")
    for strategy in ("previous", "nearest"):
        got = {r["anchor_index"]: r["frame_id"] for r in associate.associate_once(a, df, associate.target_channels(df), strategy, 1, 2).collect()}
        assert got == once(anchors, frames, strategy, 1)


def greedy(gt, pred, distance):
    taken, out = set(), {}
    for q in pred:
        near = [(np.sqrt(sum((q[3 + i] - b[3 + i]) ** 2 for i in range(3))), b[6], b[0]) for b in gt if b[1] == q[1] and b[2] == q[2] and b[0] not in taken]
        near = [n for n in near if n[0] <= distance]
        if near:
            out[q[0]] = min(near)[2]
            taken.add(out[q[0]])
    return out


@pytest.mark.parametrize("rounds", [0, 1, 4, 12])
def test_matches_of_one_crowded_sample(spark, rounds):
    rnd = random.Random(4)
    box = "annotation_id string, sample_id string, category string, x double, y double, z double, gt_pos long"
    at = lambda: round(rnd.uniform(-4, 4), 1)
    gt = [(f"g{i}", "s", "car", at(), at(), rnd.choice([0.0, 0.5]), i) for i in range(300)]
    pred = [(f"p{i}", "s", "car", at(), at(), 0.0, i) for i in range(300)]
    gt += [("g-inf", "s", "car", float("inf"), 0.0, 0.0, 300), ("g-null", "s", "car", None, 0.0, 0.0, 301)]
    g = spark.createDataFrame(gt, box)
    p = spark.createDataFrame(pred, box.replace("annotation_id", "prediction_id").replace("gt_pos", "pred_pos"))
    got = {r["prediction_id"]: r["annotation_id"] for r in evaluate.matches(g, p, 0.7, rounds).collect()}
    assert got == greedy(gt[:300], pred, 0.7)


def test_pairs_are_near_those_found(spark):
    rng = np.random.default_rng(3)
    rows = [(f"b{i}", "s", "car", float(x), float(y), 0.0, i) for i, (x, y) in enumerate(rng.uniform(0, 300, (3000, 2)))]
    g = spark.createDataFrame(rows, "annotation_id string, sample_id string, category string, x double, y double, z double, gt_pos long")
    p = g.withColumnsRenamed({"annotation_id": "prediction_id", "gt_pos": "pred_pos"})
    plan = evaluate.candidates(g, p, 2.0)
    plan.collect()
    cell = lambda df: df.select(F.floor(F.col("x") / 2).alias("a"), F.floor(F.col("y") / 2).alias("b"))
    near = cell(g).groupBy("a", "b").count()
    assert near.agg(F.max("count")).first()[0] < 12
    assert plan.count() < 3000 * 4


def test_boxes_by_image_cells_equal_all_pairs(spark):
    rng = np.random.default_rng(6)
    unit = lambda: (lambda q: (q / np.linalg.norm(q)).tolist())(rng.normal(size=4))
    points = [(f"l{f}", k, *map(float, rng.uniform(-30, 30, 3))) for f in range(2) for k in range(400)]
    sensors = [(unit(), rng.uniform(-1, 1, 3).tolist(), unit(), rng.uniform(-1, 1, 3).tolist(), unit(), [0.0] * 3, [[300.0, 0.0, 800.0], [0.0, 300.0, 450.0], [0.0, 0.0, 1.0]]) for _ in range(3)]
    rows = []
    for i in range(60):
        x, y = rng.uniform(-200, 1500), rng.uniform(-100, 900)
        w, h = rng.choice([5, 80, 700, 40_000]), rng.choice([5, 80, 700, 40_000])
        rows.append((f"d{i}", f"l{i % 2}", float(x), float(y), float(x + w), float(y + h), 1600 if i % 10 else None, 900, *sensors[i % 3]))
    kinds = "detection_id string, lidar_frame_id string, x1 double, y1 double, x2 double, y2 double, width int, height int, camera_rotation array<double>, camera_translation array<double>, lidar_rotation array<double>, lidar_translation array<double>, ego_rotation array<double>, ego_translation array<double>, intrinsic array<array<double>>"
    d, pts = spark.createDataFrame(rows, kinds), spark.createDataFrame(points, "frame_id string, point_pos long, x double, y double, z double")
    found = lift.frustum_points(d, pts)
    got = {(r["detection_id"], r["point_pos"]): r["frustum_point_count"] for r in found.collect()}
    want = {}
    turn = lambda q: np.array([[1 - 2 * (q[2] ** 2 + q[3] ** 2), 2 * (q[1] * q[2] - q[0] * q[3]), 2 * (q[1] * q[3] + q[0] * q[2])], [2 * (q[1] * q[2] + q[0] * q[3]), 1 - 2 * (q[1] ** 2 + q[3] ** 2), 2 * (q[2] * q[3] - q[0] * q[1])], [2 * (q[1] * q[3] - q[0] * q[2]), 2 * (q[2] * q[3] + q[0] * q[1]), 1 - 2 * (q[1] ** 2 + q[2] ** 2)]])
    for r in rows:
        if r[6] is None:
            continue
        scale, own = min(1333 / max(r[6], r[7]), 1.0), []
        for f, k, *xyz in points:
            if f != r[1]:
                continue
            ego = turn(r[10]) @ np.array(xyz) + np.array(r[11])
            cam = turn(r[8]).T @ (ego - np.array(r[9]))
            if cam[2] > 0.1 and ego[2] > 0:
                u, v = 300 * cam[0] / cam[2] + 800, 300 * cam[1] / cam[2] + 450
                if r[2] / scale <= u <= r[4] / scale and r[3] / scale <= v <= r[5] / scale:
                    own.append(k)
        if len(own) >= 3:
            want |= {(r[0], k): len(own) for k in own}
    assert got == want and len(want) > 150
