"""Files by byte ranges: every split point of an array, and points over several ranges."""

import json
import os

import numpy as np
import pytest

from vistalog.sources import arrays, ranges, readers

ROWS = [{"a": 'x"]},{[\\', "b": [1, 2], "c": {"d": "é日\U0001f600", "e": None}}, {"a": "", "b": [], "c": None}, {"a": "\\\\\"", "b": [3], "c": {"d": "[{", "e": "\n"}}, {"a": None, "b": None, "c": None}]
KIND = "a string, b array<long>, c struct<d:string,e:string>"


def composed(data, size):
    """Elements of an array that is cut every ``size`` bytes."""
    escaped, inside, depth, out = 0, 0, 0, []
    for start in range(0, len(data), size):
        part = data[start : start + size]
        for a, e, begins in arrays.pieces(part, bool(escaped), bool(inside), depth):
            if begins:
                out.append(b"")
            out[-1] += part[a:e]
        odd, pending, outer, inner = arrays.effects(part)[4 * escaped : 4 * escaped + 4]
        depth += inner if inside else outer
        escaped, inside = pending, inside ^ odd
    return [json.loads(x) for x in out if x.strip()]


@pytest.mark.parametrize("text", [json.dumps(ROWS), json.dumps(ROWS, ensure_ascii=False, indent=1), " [ ] ", "[1, [2, [3]], \"a,]\\\\\", {\"k\": \"\\\"\"}]\n", json.dumps(ROWS) + ",\n"])
def test_every_range_width(text):
    data = text.encode()
    want = json.JSONDecoder().raw_decode(text.strip())[0]
    for size in range(1, len(data) + 1):
        assert composed(data, size) == want


@pytest.mark.parametrize("size", [7, 40, 1 << 20])
def test_arrays_equal_sparks_own_reader(spark, tmp_path, size):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps(ROWS[i:] * (i + 1), ensure_ascii=i == 1, indent=i or None))
    (tmp_path / "empty.json").write_text("[]")
    want = spark.read.schema(KIND).json(str(tmp_path), multiLine=True)
    got = arrays.json_array(spark, str(tmp_path), KIND, size)
    assert sorted(map(str, got.drop("file", "at").collect())) == sorted(map(str, want.collect()))
    one = got.where("file like '%0.json'").orderBy("at").select("a").collect()
    assert [r["a"] for r in one] == [r["a"] for r in ROWS]


def test_a_file_that_is_no_array_is_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": "x"}')
    with pytest.raises(Exception, match="not one array"):
        arrays.json_array(spark, str(tmp_path), KIND).collect()


def test_points_over_many_ranges(spark, tmp_path):
    points = np.arange(5 * 1000, dtype="<f4").reshape(-1, 5)
    points.tofile(tmp_path / "big.pcd.bin")
    points[:3].tofile(tmp_path / "small.bin")
    (tmp_path / "_hidden.bin").write_bytes(b"xx")
    df = readers.lidar_points(spark, str(tmp_path), 333)
    assert df.rdd.getNumPartitions() == -(-20_000 // 320) + 1
    rows = df.where("frame_id = 'big'").orderBy("point_pos").collect()
    assert [(r["point_pos"], r["x"], r["ring"]) for r in rows] == [(i, 5.0 * i, 5.0 * i + 4) for i in range(1000)]
    (tmp_path / "broken.bin").write_bytes(b"x" * 21)
    with pytest.raises(Exception, match="whole points"):
        readers.lidar_points(spark, str(tmp_path)).collect()


def test_points_round_trip_and_failed_writes_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(3000).selectExpr("concat('f', id % 5) as frame_id", "id as point_pos", "id / 2 as x", "-id as y", "0.5 as z")
    ranges.write_lidar_points(df, path)
    got = ranges.lidar_points(spark, path, 400)
    assert got.count() == 3000 and got.where("x <> (point_pos * 5 + cast(substr(frame_id, 2) as int)) / 2 or y <> -2 * x or intensity <> 0").isEmpty()
    assert sorted(os.listdir(path)) == [f"f{i}.bin" for i in range(5)]
    with pytest.raises(Exception):
        ranges.write_lidar_points(df.selectExpr("case when point_pos = 2999 then 'a/b' else concat('g', frame_id) end as frame_id", "point_pos", "x", "y", "z"), path)
    assert sorted(os.listdir(path)) == [f"f{i}.bin" for i in range(5)]
