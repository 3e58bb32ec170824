"""Segments of a replayed stream against the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from vistalog.operators import segment
from vistalog.streaming import live

KIND = "sequence_id string, frame_id string, timestamp_us long, channel string"


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def replay(spark, tmp_path, files, **limits):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.live_parts(live.frame_stream(spark, str(tmp_path / "in"), KIND), **limits)
    name = "parts" + tmp_path.name.translate({ord(c): "_" for c in "-[]"})
    query = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(map(tuple, spark.table(name).select("group_key", "segment_index", "start_us", "end_us", "frame_count").collect()))


@pytest.mark.parametrize("limits", [{}, {"max_duration_us": 3_000_000}, {"max_frame_count": 5, "min_frame_count": 3}, {"max_duration_us": 2_000_000, "max_frame_count": 6, "min_duration_us": 900_000}])
def test_replayed_frames_give_the_segments_of_the_batch(spark, tmp_path, rocksdb, limits):
    rnd = random.Random(4)
    rows, t = [], 1_000_000_000
    for i in range(400):
        t += rnd.choice([100_000, 250_000, 500_000, 500_001, 900_000])
        rows.append((rnd.choice(["a", "b", None]) if i % 2 else "a", f"f{i}", t, "c"))
    # Neighbours trade places within the delay, also across files.
    mixed = sorted(rows, key=lambda r: r[2] + rnd.uniform(-2e6, 2e6))
    end = [(s, f"end{s}", t + 3_600_000_000, "c") for s in ("a", "b", None)]
    got = replay(spark, tmp_path, [mixed[:130], mixed[130:270], mixed[270:], end], max_gap_us=500_000, **limits)
    frames = spark.createDataFrame(rows, KIND).withColumn("modality", F.lit("camera")).withColumn("pos", F.monotonically_increasing_id())
    batch = segment.rollup(segment.segments(frames, max_gap_us=500_000, **limits))
    want = sorted(map(tuple, batch.select("group_key", "segment_index", "start_us", "end_us", "frame_count").collect()))
    assert got == want and len(want) > 10


def test_frames_later_than_the_delay_are_left_out(spark, tmp_path, rocksdb):
    files = [[("a", "1", 1_000_000, "c"), ("a", "2", 60_000_000, "c")], [("a", "3", 120_000_000, "c")], [("a", "late", 1_200_000, "c"), ("a", "4", 900_000_000, "c")]]
    got = replay(spark, tmp_path, files)
    assert [r[2:] for r in got if r[2] < 100_000_000 and r[3] >= 60_000_000] == [(60_000_000, 60_000_000, 1)] and ("a", 0, 1_000_000, 1_000_000, 1) in got
