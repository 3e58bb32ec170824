"""JSON files that are one array, parsed by byte ranges.

What a range means depends on whether it begins in a string and how deep. Each range is scanned once for all beginnings: by
quote parity and a pending escape, with the change of depth. These few numbers a range are added up along a file, and then
each range, knowing how it begins, cuts itself at the borders of elements. What lies across borders of ranges is put together,
and Spark parses the elements.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.steps import written
from . import ranges

_ESCAPE = re.compile(rb"\\(.?)", re.S)


def marks(data: bytes, escaped: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of quotes, brackets and commas that are not escaped, their bytes, and whether the last byte escapes the next."""
    a, pending = np.frombuffer(data, np.uint8), False
    plain = np.ones(len(a), bool)
    plain[: int(escaped)] = False
    if b"\\" in data:
        for m in _ESCAPE.finditer(data, int(escaped)):
            if m.group(1):
                plain[m.start(1)] = False
            else:
                pending = True
    elif escaped and not data:
        pending = True
    at = np.flatnonzero(plain & np.isin(a, np.frombuffer(b'"[]{},', np.uint8)))
    return at, a[at], pending


_STEP = np.zeros(256, np.int64)
_STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1


def effects(data: bytes) -> list[int]:
    """For a beginning without and with a pending escape: quotes are odd, an escape is pending, depth change outside and in a string."""
    out = []
    for escaped in (False, True):
        _, kinds, pending = marks(data, escaped)
        inside = np.cumsum(kinds == 34) % 2 == 1
        step = _STEP[kinds]
        out += [int((kinds == 34).sum() % 2), int(pending), int(step[~inside].sum()), int(step[inside].sum())]
    return out


def pieces(data: bytes, escaped: bool, in_string: bool, depth: int) -> list[tuple[int, int, bool]]:
    """(start, end, begins) of what lies between borders of elements; begins is false for what an earlier range began."""
    at, kinds, _ = marks(data, escaped)
    outside = np.cumsum(kinds == 34) % 2 == int(in_string)
    at, kinds = at[outside & (kinds != 34)], kinds[outside & (kinds != 34)]
    after = depth + np.cumsum(_STEP[kinds])
    opens, closes, commas = (_STEP[kinds] > 0) & (after == 1), (_STEP[kinds] < 0) & (after == 0), (kinds == 44) & (after == 1)
    out, start, begins = [], 0 if depth > 0 else None, False
    for i in np.flatnonzero(opens | closes | commas).tolist():
        if start is not None:
            out.append((start, int(at[i]), begins))
        start, begins = (None, False) if closes[i] else (int(at[i]) + 1, True)
    if start is not None:
        out.append((start, len(data), begins))
    return out


def json_array(spark: SparkSession, path: str, schema: str, range_bytes: int = 64 << 20) -> DataFrame:
    """Rows of ``schema`` with file and at, an element's file and the byte after its border, for the files under ``path``, each an array of objects.

    Elements are found by their borders, so they may hold strings with brackets, quotes and escapes; one that is larger than a
    range is put together. What follows the array's end is ignored; a file that is not an array, or an element that is broken, is
    an error. Runs jobs that write a few numbers a range to the shared folder.
    """
    ranges.register(spark)
    raw = spark.read.format("byte_ranges").option("range_bytes", range_bytes).load(path)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for start, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if start == 0 and not data.removeprefix(b"\xef\xbb\xbf").lstrip().startswith(b"["):
                    raise ValueError("a file is not one array")
                rows.append(effects(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int64()))], ["path", "start", "effects"])

    def along(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("start")
        escaped, inside, depth, out = 0, 0, 0, []
        for e in group["effects"]:
            out.append((escaped, inside, depth))
            odd, pending, outer, inner = e[4 * escaped : 4 * escaped + 4]
            depth += int(inner if inside else outer)
            escaped, inside = int(pending), int(inside ^ odd)
        states = pd.DataFrame(out, columns=["escaped", "inside", "depth"])
        return pd.concat([group[["path", "start"]].reset_index(drop=True), states], axis=1)

    measured = raw.mapInArrow(measure, "path string, start long, effects array<long>")
    states = written(measured.groupBy("path").applyInPandas(along, "path string, start long, escaped long, inside long, depth long"), "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = pieces(row["data"], bool(row["escaped"]), bool(row["inside"]), row["depth"])
                for a in range(0, len(found), 10_000):
                    own = found[a : a + 10_000]
                    last = [row["start"] + e for _, e, _ in own]
                    data = [row["data"][s:e] for s, e, _ in own]
                    ends = [e < len(row["data"]) for _, e, _ in own]
                    yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * len(own)), pa.array([row["start"] + s for s, _, _ in own], pa.int64()), pa.array(last, pa.int64()), pa.array([b for _, _, b in own]), pa.array(ends), pa.array(data, pa.binary())], ["file", "at", "end", "begins", "ends", "data"])

    parts = raw.join(states, ["path", "start"]).select("path", "start", "data", "escaped", "inside", "depth").mapInArrow(cut, "file string, at long, end long, begins boolean, ends boolean, data binary")
    # Whole elements need no shuffle; the few that cross ranges are numbered by what begins them, along the file.
    whole = parts.where("begins and ends").select("file", "at", F.col("data").cast("string").alias("text"))
    crossing = parts.where("not (begins and ends)").withColumn("at_first", F.max(F.when(F.col("begins"), F.col("at"))).over(Window.partitionBy("file").orderBy("at")))
    joined = crossing.groupBy("file", F.col("at_first").alias("at")).agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("k"), "data"))).alias("parts"))
    text = F.decode(F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["data"])), "")), "UTF-8")
    elements = whole.unionByName(joined.select("file", "at", text.alias("text"))).where(F.col("text").rlike(r"\S"))
    parsed = elements.withColumn("v", F.from_json("text", schema, {"mode": "FAILFAST"}))
    return parsed.select("v.*", "file", "at")
