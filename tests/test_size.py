"""Work that a query must not do twice."""

from pyspark.sql import functions as F

from vistalog.operators import associate, ingest, validate
from vistalog.plans import registry
from vistalog.sources import arrays, ranges

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return plan(df).count("Exchange hashpartitioning")


def test_lists_of_attributes_are_a_box_s_own(spark):
    boxes = spark.createDataFrame([("b1", "s", ["x", "y"]), ("b1", "s", ["y"]), ("b2", "s", None), ("b3", "s", ["y", "?", "x", "y"])], "token string, sample_token string, attribute_tokens array<string>")
    ordered = spark.createDataFrame([("s", "scene", "sample", 1)], "token string, scene_id string, sample_id string, timestamp_us long")
    attributes = spark.createDataFrame([("x", "X"), ("y", "Y")], "token string, name string")
    want = [("b1", ["X", "Y"]), ("b1", ["Y"]), ("b2", []), ("b3", ["Y", "X", "Y"])]
    for lists in (None, boxes.select("attribute_tokens")):
        out = ingest.annotations(ordered, boxes, attributes, lists)
        assert sorted((r["token"], r["attributes"]) for r in out.collect()) == want
        assert "token" not in [c for c in plan(out).split("hashpartitioning(") if c.startswith("token#")]


def test_missing_channels_of_samples_take_one_shuffle(spark):
    rows = [("a", "s1", "C"), ("a", "s2", None), ("b", "s1", "L"), ("b", None, "C"), (None, "s3", "L"), (None, "s3", "L")]
    frames = spark.createDataFrame(rows, "scene_id string, sample_id string, channel string").withColumn("x", F.rand(1) > 2)
    out = validate.sample_missing_channels(frames, ["C", "L", "C"])
    assert exchanges(out) == 1
    got = sorted((r["scene_id"] or "", r["ref_id"] or "", r["channel"]) for r in out.collect())
    assert got == sorted([("a", "s2", c) for c in "CLC"] + [("b", "", c) for c in "CLC"] + [("", "s3", c) for c in "CC"])


def test_rules_asked_for_alone_are_made_alone(spark):
    assert "scene_calibrations" not in (p := plan(registry.queries()["v3_sample_missing_channels"](spark, SMALL))) and exchanges(registry.queries()["v3_sample_missing_channels"](spark, SMALL)) == 1, p
    assert exchanges(registry.queries()["v2_missing_channels"](spark, SMALL)) <= 5


def test_batches_are_one_pass(spark):
    df = registry.queries()["v9_batch_verdict"](spark, SMALL)
    assert plan(df).count("FileScan") <= plan(registry.queries()["v8_verdicts"](spark, SMALL)).count("FileScan")


def test_strategies_and_centres_score_once(spark):
    for name in ("x4_strategies", "x4_k_centres"):
        assert "lineitem" not in plan(registry.queries()[name](spark, SMALL)), name


def test_ranges_share_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b"[" + b",".join(b'{"k":%d}' % i for i in range(200_000)) + b"]")
    ranges.register(spark)
    raw = spark.read.format("byte_ranges").option("range_bytes", 1000).load(str(tmp_path))
    assert raw.rdd.getNumPartitions() <= 200 and raw.count() > 1000
    got = arrays.json_array(spark, str(tmp_path), "k long", 1000).agg(F.sum("k"), F.count("*")).first()
    assert tuple(got) == (199_999 * 100_000, 200_000)


def test_frames_once_in_a_crowd(spark, tmp_path):
    """4000 anchors and 4000 frames of one time span: each frame is taken once, and no pairs of them are made."""
    at = lambda n, kind: [("s", kind, i % 40, i, f"{kind}{i}") for i in range(n)]
    frames = spark.createDataFrame(at(4000, "f"), "segment_id string, channel string, timestamp_us long, pos long, frame_id string")
    anchors = frames.selectExpr("segment_id", "timestamp_us", "row_number() over (order by timestamp_us, pos) - 1 as anchor_index")
    kept = []
    old, associate.written = associate.written, lambda df, name: kept.append(old(df, name)) or kept[-1]
    try:
        out = associate.associate_once(anchors, frames, associate.target_channels(frames), "nearest", 100).collect()
    finally:
        associate.written = old
    assert len({r["frame_id"] for r in out}) == 4000 and all(r["offset_us"] == 0 for r in out)
    assert max(df.count() for df in kept) <= 4 * 4000
