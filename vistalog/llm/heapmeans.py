"""Centroid clustering of integer vectors, exact, with heap-ordered bounds.

A vector's gap is the least distance to another centroid minus that to its own. When centroids move, the gap shrinks by
at most the way of its own centroid and the longest way of another; each cluster adds these up. A cluster's heap in a
block of vectors is ordered by gap plus the sum at the time when the vector was put in, so the vectors whose gap may be
used up are on top: they alone are popped, compared with all centroids again, exactly, and put back.

Vectors are written once, in blocks that are bucketed by block; the state of a block, its heaps, is a small row of a table
with the same buckets, written anew each round. So a round moves no vector through a shuffle, blocks without a used-up
gap are not joined, and centroids follow from the sums of the vectors that changed.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, new_path, slices, written

#: Components below this keep 64 squared differences within 64 bits.
LARGEST = 2**27
_SLACK = 1e-12
_MOVED = pa.list_(pa.struct([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))
_STATE = "block long, cluster binary, keys binary, members binary, sizes array<int>, tops array<double>, moved array<struct<cluster:int,n:bigint,sums:array<bigint>>>"
_FIELDS = pa.schema([("block", pa.int64()), ("cluster", pa.binary()), ("keys", pa.binary()), ("members", pa.binary()), ("sizes", pa.list_(pa.int32())), ("tops", pa.list_(pa.float64())), ("moved", _MOVED)])


def quantised(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component, of the vectors with ``dim`` components that are all finite."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.where(x.isNotNull() & (F.size(x) == dim) & finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def blocks_of(rows: DataFrame, dim: int, most: int) -> DataFrame:
    """block, ids and vectors (32-bit integers) of up to ``most`` vectors each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            for a, b in slices([1] * batch.num_rows, most):
                part = batch.slice(a, b - a)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                if np.abs(v).max(initial=0) >= LARGEST or (v == np.iinfo(np.int64).min).any():
                    raise ValueError(f"a quantised component reaches {LARGEST}: distances would pass 64 bits")
                ids = pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([block]), ids, pa.array([v.astype(np.int32).tobytes()], pa.binary())], ["block", "ids", "vectors"])
                block += 1

    return rows.select("vec_id", "v").mapInArrow(run, "block long, ids array<long>, vectors binary")


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (vector, centroid), exact in 64 bits."""
    out = np.empty((len(x), len(centroids)), np.int64)
    for c, centre in enumerate(centroids):
        d = x - centre
        out[:, c] = (d * d).sum(1)
    return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the smaller number of a tie, and a lower bound of the gap to the next one."""
    d2 = squared(x, centroids)
    own = d2.argmin(1)
    at = np.arange(len(x))
    d = np.sqrt(d2.astype(np.float64))
    near = d[at, own]
    d[at, own] = np.inf
    return own, d.min(1) * (1 - _SLACK) - near * (1 + _SLACK)


def _changes(x: np.ndarray, old: np.ndarray | None, new: np.ndarray, k: int) -> list[dict]:
    """What the vectors that changed add to the numbers and sums of clusters."""
    out = []
    for c in range(k):
        come, gone = (new == c) if old is None else (new == c) & (old != c), None if old is None else (old == c) & (new != c)
        n, sums = int(come.sum()), x[come].sum(0)
        if gone is not None:
            n, sums = n - int(gone.sum()), sums - x[gone].sum(0)
        if n or sums.any():
            out.append({"cluster": c, "n": n, "sums": sums.tolist()})
    return out


def _packed(block: int, cluster: np.ndarray, heaps: list[list[tuple[float, int]]], moved: list[dict]) -> dict:
    keys = np.array([key for h in heaps for key, _ in h], np.float64)
    members = np.array([i for h in heaps for _, i in h], np.int32)
    return {"block": block, "cluster": cluster.astype(np.int16).tobytes(), "keys": keys.tobytes(), "members": members.tobytes(), "sizes": [len(h) for h in heaps], "tops": [h[0][0] if h else float("inf") for h in heaps], "moved": moved}


def _unpacked(row: dict) -> tuple[np.ndarray, list[list[tuple[float, int]]]]:
    pairs = list(zip(np.frombuffer(row["keys"], np.float64).tolist(), np.frombuffer(row["members"], np.int32).tolist(), strict=True))
    ends = np.cumsum([0, *row["sizes"]])
    return np.frombuffer(row["cluster"], np.int16).astype(np.int64), [pairs[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _vectors(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32).reshape(-1, dim).astype(np.int64)


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The state after the first assignment: all vectors are compared with all centroids, and make their clusters' heaps."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = _vectors(row["vectors"], dim)
                own, gap = nearest(x, centroids)
                heaps = [[(float(gap[i]), int(i)) for i in np.flatnonzero(own == c)] for c in range(k)]
                for h in heaps:
                    heapq.heapify(h)
                yield pa.RecordBatch.from_pylist([_packed(row["block"], own, heaps, _changes(x, None, own, k))], _FIELDS)

    return blocks.select("block", "vectors").mapInArrow(run, _STATE)


def rescanned(state: DataFrame, blocks: DataFrame, centroids: np.ndarray, drifted: list[float]) -> DataFrame:
    """The state after centroids have moved; ``drifted`` is the sum of what each cluster's gaps have shrunk by so far."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cluster, heaps = _unpacked(row)
                popped = []
                for c, h in enumerate(heaps):
                    while h and h[0][0] <= drifted[c]:
                        popped.append(heapq.heappop(h)[1])
                at = np.array(popped, np.int64)
                x = np.frombuffer(row["vectors"], np.int32).reshape(-1, dim)[at].astype(np.int64)
                own, gap = nearest(x, centroids)
                moved = _changes(x, cluster[at], own, k)
                cluster[at] = own
                for i, c, g in zip(popped, own.tolist(), gap.tolist(), strict=True):
                    heapq.heappush(heaps[c], (g + drifted[c], i))
                yield pa.RecordBatch.from_pylist([_packed(row["block"], cluster, heaps, moved)], _FIELDS)

    used_up = F.exists(F.zip_with("tops", F.array(*[F.lit(float(d)) for d in drifted]), lambda t, d: t <= d), lambda b: b)
    due = state.where(used_up).drop("moved").hint("merge").join(blocks.select("block", "vectors"), "block")
    rest = state.where(~used_up).withColumn("moved", F.lit(None).cast(state.schema["moved"].dataType))
    return due.mapInArrow(run, _STATE).unionByName(rest)


class _Tables:
    """Tables in the shared folder that are bucketed by block; the session's catalog knows them until drop()."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.names = spark, buckets, []

    def write(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path, table = new_path(self.spark, name), f"{name}_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "block").option("path", path).saveAsTable(table)
        self.names.append(table)
        return self.spark.table(table), path

    def drop(self) -> None:
        for table in self.names:
            self.spark.sql(f"drop table if exists {table}")


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors whose ids, after the seed, have the smallest hashes; fewer than ``k`` if there are fewer vectors."""
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    # k rows.
    return np.array([r["v"] for r in rows.orderBy(by.asc_nulls_last(), "v").limit(k).select("v").collect()], np.int64)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, block: int = 2000) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 for each vector of ``vectors`` (vec_id, embedding).

    Vectors without exactly ``dim`` components, or with one that is null or not finite, are left out. Components are
    floor(scale * x); one of 2 ** 27 or more is an error. ``rounds`` times vectors go to the nearest centroid, of a tie
    the smaller number, and centroids of clusters that have vectors become the floor of their mean; then vectors are
    assigned once more. Repeated rows are vectors of their own. A null vec_id is kept, but seeds only if others are too
    few; fewer vectors than ``k`` give fewer clusters, none give no row. Runs jobs that write to the shared folder.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = quantised(vectors, dim, scale)
    centroids = first_centroids(rows, k, seed)
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], out)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = _Tables(spark, buckets)
    try:
        placed = written(blocks_of(rows, dim, block), "blocks")
        blocks, _ = tables.write(placed.repartition(buckets, "block"), "heap_blocks")
        state, path = tables.write(assigned(blocks, centroids), "heap_state")
        n, sums = [0] * len(centroids), [[0] * dim for _ in centroids]
        drifted = [0.0] * len(centroids)
        for _ in range(rounds):
            each = state.select(F.inline("moved")).groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dim)]).alias("sums"))
            for r in each.collect():  # a row for each cluster
                n[r["cluster"]] += r["n"]
                sums[r["cluster"]] = [a + b for a, b in zip(sums[r["cluster"]], r["sums"], strict=True)]
            new = np.array([[s // c for s in own] if c else old.tolist() for own, c, old in zip(sums, n, centroids, strict=True)], np.int64)
            ways = np.sqrt(((new - centroids) ** 2).sum(1).astype(np.float64)).tolist()
            centroids = new
            if not any(ways):
                break
            others = [max([w for j, w in enumerate(ways) if j != c], default=0.0) for c in range(len(ways))]
            drifted = [(d + w + o) * (1 + _SLACK) for d, w, o in zip(drifted, ways, others, strict=True)]
            state, path = tables.write(rescanned(state, blocks, centroids, drifted), "heap_state")
        found = written(_distances(state, blocks, centroids), "distances")
    finally:
        tables.drop()
    hashes = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    total = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # A row for each cluster.
    known = {r["cluster"]: r["cluster_inertia"] for r in total.collect()}
    table = spark.createDataFrame([(c, s, sum(known.values()), hashes[c]) for c, s in known.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _distances(state: DataFrame, blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of each vector."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = np.frombuffer(batch.column(0)[i].as_py(), np.int16).astype(np.int64)
                d = _vectors(batch.column(2)[i].as_py(), dim) - centroids[own]
                yield pa.RecordBatch.from_arrays([batch.column(1)[i].values, pa.array(own.astype(np.int32)), pa.array((d * d).sum(1))], ["vec_id", "cluster", "distance"])

    both = state.select("block", "cluster").hint("merge").join(blocks, "block")
    return both.select("cluster", "ids", "vectors").mapInArrow(run, "vec_id long, cluster int, distance long")


def oracle(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """SQL of cluster() by plain assignment of all vectors in each round, for DuckDB."""
    near = lambda r: f"""d{r} as materialized (select v.vec_id, c.c, sum((v.x - c.x) * (v.x - c.x)) as d from v join c{r} c using (i) group by all),
a{r} as materialized (select vec_id, c, d from d{r} qualify row_number() over (partition by vec_id order by d, c) = 1)"""  # noqa: E731
    steps = [near(0)]
    for r in range(1, rounds + 1):
        p = r - 1
        steps.append(f"""s{r} as (select a.c, v.i, sum(v.x) as s, count(*) as n from a{p} a join v using (vec_id) group by all),
c{r} as materialized (select c.c, c.i, case when s.n is null then c.x else cast((s.s - ((s.s % s.n) + s.n) % s.n) // s.n as bigint) end as x from c{p} c left join s{r} s using (c, i)),
{near(r)}""")
    return f"""
with kept as (select vec_id, embedding from embeddings where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is not null and isfinite(cast(x as double)))) = {dim}),
v as materialized (select vec_id, generate_subscripts(embedding, 1) as i, cast(floor({scale} * cast(unnest(embedding) as double)) as bigint) as x from kept),
f as (select vec_id, row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as c from kept order by c limit {k}),
c0 as materialized (select f.c, v.i, v.x from f join v using (vec_id)),
{(","+chr(10)).join(steps)},
h as (select c, sha256(string_agg(cast(x as varchar), ',' order by i)) as centroid_sha256 from c{rounds} group by c)
select vec_id, cast(c as integer) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, centroid_sha256 from a{rounds} join h using (c)"""
