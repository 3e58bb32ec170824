"""Chains over rows in time order, where each link depends on the last: limits that count from the last cut.

A row's successor, the first row beyond its limits, is known without the rows before it, so rows and successors are a
graph, and the rows where parts start are the path from a key's first row. Rows are cut into time buckets at least
as wide as the limit. Within a bucket pointers jump locally, from each row at which a part from an earlier bucket can
end to the bucket's last start and on to the row after it, which is among the first rows of one of the next two buckets.
Over these rows alone pointers double, in log2(buckets) rounds of joins, and the path is marked from the longest
jumps to the shortest. So one long key is many tasks, and the rounds follow its buckets, not its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .folds import key_starts, sorted_fold, whole_keys
from .steps import written

BUCKETS_WIDE = 16


def successors(t: np.ndarray, rank: np.ndarray, new: np.ndarray, own: np.ndarray, beyond: int, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """For each row: how many starts there are from it to the last start of its bucket, and the index of the row after that, or -1.

    Rows of many buckets stand one after another, each bucket's ``own`` rows and then those of later ones, in order; ``new``
    marks a bucket's first. Times and ranks are moved so that buckets lie too far apart to see each other. Pointers double.
    """
    first = np.flatnonzero(new)
    bucket = np.cumsum(new) - 1
    ends = np.append(first[1:], len(t)) - 1

    def apart(x: np.ndarray, gap: int) -> np.ndarray:
        spans = x[ends] - x[first] + gap + 1
        return x - x[first][bucket] + (np.cumsum(spans) - spans)[bucket]

    moved = apart(t, beyond)
    nxt = np.searchsorted(moved, moved + beyond, "right")
    if most:
        moved = apart(rank, most)
        nxt = np.minimum(nxt, np.searchsorted(moved, moved + most, "left"))
    nxt = np.where(nxt > ends[bucket], -1, nxt)
    inside = (nxt >= 0) & own[np.maximum(nxt, 0)]
    jump, n = np.where(inside, nxt, np.arange(len(t))), inside.astype(np.int64)
    while n[jump].any():
        n, jump = n + n[jump], jump[jump]
    return n + 1, nxt[jump]


def _first_nodes(placed: DataFrame, keys: list[str], time: str, beyond: int, most: int | None, width: int) -> DataFrame:
    """keys, _bucket, node, starts, to: for each row where an earlier part can end, the starts of its bucket from there and the
    first start after the bucket. Rows are known by their number in the key."""
    in_bucket = Window.partitionBy(*keys, "_bucket").orderBy("_rank")
    before = F.lag(time).over(in_bucket)
    head = before.isNull() | (before <= F.col("_bucket") * width + beyond)
    narrow = placed.select(*keys, "_bucket", F.col(time).alias("_t"), "_rank", "_one", "_two", head.alias("_head"), before.isNull().alias("_first"))
    copies = F.array_compact(F.array(F.col("_bucket"), F.when(F.col("_head"), F.col("_one")), F.when(F.col("_first"), F.col("_two"))))
    spread = narrow.select(*keys, "_t", "_rank", "_head", F.col("_bucket").alias("_from"), F.explode(copies).alias("_bucket"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(batches, [*keys, "_bucket"]):
            t, rank, source, bucket = (rows.column(c).to_numpy() for c in ("_t", "_rank", "_from", "_bucket"))
            own = source == bucket
            starts, after = successors(t, rank, key_starts(rows, [*keys, "_bucket"]), own, beyond, most)
            at = np.flatnonzero(rows.column("_head").to_numpy(zero_copy_only=False) & own)
            to = pa.array(rank[np.maximum(after[at], 0)], pa.int64(), mask=after[at] < 0)
            yield from pa.table({**{k: rows.column(k).take(pa.array(at)) for k in keys}, "_bucket": bucket[at], "node": rank[at], "starts": starts[at], "to": to}).to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    fields = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    by = [*keys, "_bucket"]
    return spread.repartition(*by).sortWithinPartitions(*by, "_rank").mapInArrow(run, f"{fields}, _bucket long, node long, starts long, to long")


def path(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and node of the rows on the path from node 0 of each key along ``to``: jumps double until none is left, and the path
    is marked from the longest to the shortest. Each round of jumps is written."""
    keys = list(keys)
    jumps = [nodes.where("to is not null").select(*keys, "node", "to")]
    while True:
        a, b = jumps[-1], jumps[-1].select(*keys, F.col("node").alias("to"), F.col("to").alias("far"))
        longer = written(a.join(b, [*keys, "to"]).select(*keys, "node", F.col("far").alias("to")), "jumps")
        if longer.isEmpty():
            break
        jumps.append(longer)
    on = nodes.where("node = 0").select(*keys, "node")
    for jump in reversed(jumps):
        on = on.join(jump, [*keys, "node"], "left").select(*keys, F.explode(F.array_compact(F.array("node", "to"))).alias("node"))
    return on


def chained(rows: DataFrame, keys: Sequence[str], order: Sequence[str], beyond_us: int, most: int | None = None, bucket_us: int | None = None) -> DataFrame:
    """``rows`` with part, the number of starts up to a row less one, and first, true for a start.

    A key's first row is a start; then the first row that lies more than ``beyond_us`` after the last start, or is the
    ``most``-th row after it. ``order`` is the time, which must not be null, and a tiebreak that is unique in a key; keys
    must not be null. Buckets are 16 limits wide unless ``bucket_us`` gives a width, of the limit at least. Runs jobs that
    write to the shared folder.
    """
    keys, (time, tie) = list(keys), order
    width = bucket_us or BUCKETS_WIDE * max(1, beyond_us)
    if width < max(1, beyond_us):
        raise ValueError("buckets must be as wide as the limit")
    by_bucket = Window.partitionBy(*keys).orderBy("_bucket")
    cut = written(rows.withColumn("_bucket", F.floor(F.col(time) / width)), "rows")
    sizes = cut.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    buckets = sizes.select(*keys, "_bucket", (F.sum("_n").over(by_bucket) - F.col("_n")).alias("_before"), F.lag("_bucket", 1).over(by_bucket).alias("_one"), F.lag("_bucket", 2).over(by_bucket).alias("_two"))
    buckets = written(buckets, "buckets")
    place = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(time, tie))
    placed = cut.select(*keys, "_bucket", time, tie).join(buckets, [*keys, "_bucket"]).withColumn("_rank", F.col("_before") + place - 1)
    nodes = written(_first_nodes(placed, keys, time, beyond_us, most, width), "nodes")
    entries = path(nodes, keys).join(nodes.select(*keys, "node", "_bucket", "starts"), [*keys, "node"])
    # A row for each bucket: where the path enters it, and the starts of earlier buckets.
    table = buckets.join(entries, [*keys, "_bucket"], "left").withColumn("_entry", F.coalesce(F.col("node") - F.col("_before"), F.lit(-1)))
    starts = F.coalesce("starts", F.lit(0))
    table = table.withColumn("_done", (F.sum(starts).over(by_bucket) - starts).cast("long")).select(*keys, "_bucket", "_entry", "_done")

    def start() -> Callable:
        at, part, first, count = -1, None, 0, 0

        def step(t: int, entry: int, done: int) -> int:
            nonlocal at, part, first, count
            at += 1
            part = done - 1 if part is None else part
            if at == entry or (0 <= entry < at and (t - first > beyond_us or (most and count >= most))):
                part, first, count = part + 1, t, 0
                count += 1
                return part * 2 + 1
            count += 1
            return part * 2

        return step

    ready = cut.join(table, [*keys, "_bucket"])
    marked = sorted_fold(ready, [*keys, "_bucket"], order, [time, "_entry", "_done"], start, "_mark", "long")
    return marked.select(*rows.columns, F.floor(F.col("_mark") / 2).cast("long").alias("part"), (F.col("_mark") % 2 == 1).alias("first"))
