"""Near-duplicate embeddings by binary codes of rotated vectors.

A code has four bits a dimension after a random rotation, the first of which is the sign, and a stored correction factor, the
inner product of the vector and its code's direction. From two codes, or a code and a whole vector, follow an unbiased
estimate of their inner product and a confidence bound; only pairs whose upper bound reaches the threshold are computed
again exactly, in double precision. (Two codes of one rotation err alike for nearly equal vectors, which raises the
estimate, so the upper bound holds.)

Pairs are sought in the cells of several tables. A table turns each vector at random, once for each of its keys; a cell is
an axis with its sign for each key, and a vector is placed in the few cells (probes) whose axes it comes nearest to in sum.
How many axes and keys a table has follows from the number of vectors, so that cells stay of one size and work grows a
little faster than the rows; tables and probes are the fewest placements that find the wanted share of links at the
threshold. A pair that meets in several cells counts in the first. Equal vectors are one node with a number of copies.

Cells get codes alone. A tile, a bounded part of a cell, tells which of its nodes have a partner that they may be linked with
and meet there first; only these nodes' vectors are then sent to that tile, which gives counts for both ends of its links
and one root for each node, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, slices, written


@lru_cache(maxsize=16)
def rotation(dim: int, seed: int = 77) -> np.ndarray:
    """A random rotation."""
    return np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))[0]


def key_axes(rows: int, dim: int, per_cell: int) -> list[int]:
    """Axes of each key of a table, such that ``rows`` vectors come to about ``per_cell`` a cell; none for so few rows."""
    out, rest = [], rows / per_cell
    while rest > 1:
        out.append(min(dim, max(1, round(rest / 2))))
        rest /= 2 * out[-1]
    return out


#: Most cells of a table that a vector is placed in, and bits a dimension of a code.
PROBES, BITS = 6, 4


def _top_cells(scores: list[np.ndarray], probes: int) -> np.ndarray:
    """The cells, (vector, probe), with the highest sums of one score a key, best first."""
    total, cell = np.zeros((len(scores[0]), 1), np.float32), np.zeros((len(scores[0]), 1), np.int64)
    for key in scores:
        few = min(probes, key.shape[1])
        best = np.argpartition(-key, few - 1, axis=1)[:, :few]
        sums = (total[:, :, None] + np.take_along_axis(key, best, 1)[:, None, :]).reshape(len(key), -1)
        ids = (cell[:, :, None] * key.shape[1] + best[:, None, :]).reshape(len(key), -1)
        order = np.argsort(-sums, axis=1, kind="stable")[:, :probes]
        total, cell = np.take_along_axis(sums, order, 1), np.take_along_axis(ids, order, 1)
    return cell


@lru_cache(maxsize=64)
def meeting(axes: tuple[int, ...], least: float, pairs: int = 20_000) -> list[float]:
    """The chance that two vectors of cosine ``least`` meet in a table, for 1, 2, ... probes: by simulation, as random axes
    make all such pairs alike. Two standard errors are taken off."""
    if not axes:
        return [1.0]
    rng, both = np.random.default_rng(9), ([], [])
    for m in axes:
        x = rng.standard_normal((pairs, m), dtype=np.float32)
        y = least * x + np.sqrt(1 - least * least) * rng.standard_normal((pairs, m), dtype=np.float32)
        for side, z in zip(both, (x, y), strict=True):
            side.append(np.concatenate([z, -z], axis=1))
    a, b = (_top_cells(side, PROBES) for side in both)
    out = []
    for r in range(1, a.shape[1] + 1):
        p = float((a[:, :r, None] == b[:, None, :r]).any((1, 2)).mean())
        out.append(min(p, 1 - 3 / pairs) - 2 * math.sqrt(p * (1 - p) / pairs))
    return out


def tables_for(axes: list[int], least: float, recall: float, probes: int = 1) -> int:
    """Tables in which all but 1 - ``recall`` of the pairs at the threshold meet once at least."""
    p = meeting(tuple(axes), least)[probes - 1]
    return 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - max(p, 1e-9)))


def placements(axes: list[int], least: float, recall: float) -> tuple[int, int]:
    """Tables and probes whose product is least."""
    each = [(tables_for(axes, least, recall, r), r) for r in range(1, len(meeting(tuple(axes), least)) + 1)]
    return min(each, key=lambda tr: (tr[0] * tr[1], tr[1]))


def cells_of(unit: np.ndarray, axes: list[int], tables: int, probes: int) -> np.ndarray:
    """The cells of each vector, (vector, table, probe), ascending; cells of later tables have higher numbers."""
    dim, single = unit.shape[1], unit.astype(np.float32)
    number = math.prod(2 * m for m in axes)
    out = np.zeros((len(unit), tables, probes), np.int64)
    for t in range(tables):
        scores = []
        for k, m in enumerate(axes):
            turned = single @ np.random.default_rng([20, dim, t, k]).standard_normal((dim, m), dtype=np.float32)
            scores.append(np.concatenate([turned, -turned], axis=1))
        if scores:
            out[:, t] = np.sort(_top_cells(scores, probes), axis=1) + t * number
    return out


def encode(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes and correction factors of unit vectors."""
    n, dim = unit.shape
    turned = unit @ rotation(dim)
    # The best even steps for normal components of this standard deviation.
    level = np.clip(np.floor(turned * (np.sqrt(dim) / 0.335)) + 2 ** (BITS - 1), 0, 2**BITS - 1).astype(np.uint8)
    bits = np.unpackbits(level[:, :, None], axis=2)[:, :, 8 - BITS :]
    codes = np.packbits(bits.reshape(n, -1), axis=1)
    return codes, (turned * directions(codes, dim)).sum(1)


def directions(codes: np.ndarray, dim: int) -> np.ndarray:
    """The unit vectors, in rotated space, that codes stand for."""
    bits = np.unpackbits(codes, axis=1, count=dim * BITS).reshape(len(codes), dim, BITS)
    level = bits @ (2 ** np.arange(BITS)[::-1]).astype(np.float32) - np.float32((2**BITS - 1) / 2)
    return level / np.sqrt((level * level).sum(1, keepdims=True))


def _error(factors: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 1 - factors * factors)) / factors


def upper_bounds(queries: np.ndarray, codes: np.ndarray, factors: np.ndarray, deviations: float) -> np.ndarray:
    """Upper confidence bounds of inner products (query, code): the unbiased estimate plus ``deviations`` times its
    standard error."""
    dim = queries.shape[1]
    turned = (queries @ rotation(dim)).astype(np.float32)
    estimate = (turned @ directions(codes, dim).T) / factors.astype(np.float32)
    return estimate + (deviations / np.sqrt(max(dim - 1, 1)) * _error(factors)).astype(np.float32)


def may_reach(a: np.ndarray, errors: np.ndarray, b: np.ndarray, largest: float, least: float, deviations: float) -> np.ndarray:
    """Pairs (a, b) whose upper confidence bound reaches ``least``, by directions over factors of both sides; ``errors``
    are those of a, and b counts with its ``largest``."""
    spread = np.sqrt(errors**2 + largest**2 + (errors * largest) ** 2)
    bar = least - deviations / math.sqrt(max(a.shape[1] - 1, 1)) * spread
    return a @ b.T >= bar.astype(np.float32)[:, None]


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def valid(vector: Column) -> Column:
    """True for a vector with components that are all finite and not all zero."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def stored(vectors: DataFrame) -> str:
    """The type that holds the components as they are given."""
    return "array<float>" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "array<double>"


@dataclass(frozen=True)
class Placing:
    """How vectors of one dimension are placed."""

    axes: list[int]
    tables: int
    probes: int

    @property
    def kind(self) -> str:
        """The numpy type that holds the numbers of cells."""
        return "u4" if self.tables * math.prod(2 * m for m in self.axes) < 2**32 else "i8"


def place(nodes: DataFrame, plan: dict[int, Placing]) -> DataFrame:
    """node, dim, cell, before (the node's cells of lower number), code and factor for each cell of each node; ``nodes`` has
    node and embedding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices([1] * batch.num_rows, 512):
                part = batch.slice(a, b - a)
                lists = part.column(1)
                sizes = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes)
                for dim in np.unique(sizes).tolist():
                    rows, how = np.flatnonzero(sizes == dim), plan[dim]
                    unit = _units(flat[(ends[rows] - dim)[:, None] + np.arange(dim)])
                    codes, factors = encode(unit)
                    cells = cells_of(unit, how.axes, how.tables, how.probes).reshape(len(rows), -1)
                    k = cells.shape[1]
                    before = [c[:i].tobytes() for c in cells.astype(how.kind) for i in range(k)]
                    code = [c.tobytes() for c in codes for _ in range(k)]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(np.repeat(rows, k))), pa.array(np.full(len(rows) * k, dim), pa.int32()), pa.array(cells.ravel()), pa.array(before, pa.binary()), pa.array(code, pa.binary()), pa.array(np.repeat(factors, k).astype(np.float32))],
                        ["node", "dim", "cell", "before", "code", "factor"],
                    )

    return nodes.select("node", F.col("embedding").cast(stored(nodes))).mapInArrow(run, "node long, dim int, cell long, before binary, code binary, factor float")


def roots(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest index reachable for rows and columns of a link matrix; indexes count rows, then columns."""
    n, m = links.shape
    row, col = np.arange(n), np.arange(n, n + m)
    far = n + m
    while True:
        new_row, new_col = row.copy(), col.copy()
        for s in range(0, n, 512):
            part = links[s : s + 512]
            new_row[s : s + 512] = np.minimum(row[s : s + 512], np.where(part, col, far).min(1, initial=far))
            new_col = np.minimum(new_col, np.where(part, new_row[s : s + 512, None], far).min(0, initial=far))
        if (new_row == row).all() and (new_col == col).all():
            return row, col
        row, col = new_row, new_col


def _sides(group: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
    return (group, group, True) if i == j else (group[group["part"] == i], group[group["part"] == j], False)


def _before(rows: pd.DataFrame, how: Placing, none: int) -> np.ndarray:
    """Cells of lower number, (table, probe, row); places without one hold ``none``."""
    out = np.full((len(rows), how.tables * how.probes), none, np.int64)
    for row, raw in zip(out, rows["before"], strict=True):
        row[: len(raw) // np.dtype(how.kind).itemsize] = np.frombuffer(raw, how.kind)
    return np.ascontiguousarray(out.T).reshape(how.tables, how.probes, -1)


def _first_met(reach: Callable[[slice, slice], np.ndarray], left: pd.DataFrame, right: pd.DataFrame, same: bool, how: Placing) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs that ``reach`` marks and that share no cell of lower number, a bounded number at a time."""
    a, b = _before(left, how, -1), _before(right, how, -2)
    for s in range(0, len(left), 512):
        start = s if same else 0
        at, to = np.nonzero(reach(slice(s, s + 512), slice(start, None)))
        at, to = at + s, to + start
        if same:
            at, to = at[at < to], to[at < to]
        for c in range(0, len(at), 1 << 18):
            p, q = at[c : c + (1 << 18)], to[c : c + (1 << 18)]
            met = np.zeros(len(p), bool)
            for mine, theirs in zip(a, b, strict=True):
                others = [x[q] for x in theirs]
                for x in mine:
                    mine_at = x[p]
                    for other in others:
                        met |= mine_at == other
            if not met.all():
                yield p[~met], q[~met]


def screen(group: pd.DataFrame, plan: dict[int, Placing], least: float, deviations: float) -> pd.DataFrame:
    """The rows of a tile that have a partner in it that they meet there first and, by their codes, may be linked with."""
    left, right, same = _sides(group)
    dim = int(group["dim"].iloc[0])
    near_a, near_b = np.zeros(len(left), bool), np.zeros(len(right), bool)
    if len(left) and len(right):
        sides = []
        for rows in (left, right):
            codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
            factors = rows["factor"].to_numpy()
            sides.append((directions(codes, dim) / factors[:, None], _error(factors)))
        (x, errors), (y, others) = sides
        for p, q in _first_met(lambda r, c: may_reach(x[r], errors[r], y[c], others.max(), least, deviations), left, right, same, plan[dim]):
            near_a[p] = near_b[q] = True
    kept = group[near_a | near_b] if same else pd.concat([left[near_a], right[near_b]])
    return kept[["dim", "cell", "i", "j", "part", "node", "before"]]


def meet(group: pd.DataFrame, plan: dict[int, Placing], least: float, deviations: float) -> pd.DataFrame:
    """node, links and root of the nodes that a tile's rows of one cell link: those of part i against those of part j."""
    left, right, same = _sides(group)
    dim = int(group["dim"].iloc[0])
    none = pd.DataFrame({"node": [], "links": [], "root": []}, dtype=np.int64)
    if not len(left) or not len(right):
        return none
    x = _units(np.stack(left["embedding"].to_list()))
    y = x if same else _units(np.stack(right["embedding"].to_list()))
    codes, factors = encode(y)
    links = np.zeros((len(left), len(right)), bool)
    for p, q in _first_met(lambda r, c: upper_bounds(x[r], codes[c], factors[c], deviations) >= least, left, right, same, plan[dim]):
        for c in range(0, len(p), 50_000):
            a, b = p[c : c + 50_000], q[c : c + 50_000]
            links[a, b] = np.einsum("ij,ij->i", x[a], y[b]) >= least
    near_a, near_b = links.any(1), links.any(0)
    links = links[near_a][:, near_b]
    a, b = left["node"].to_numpy()[near_a], right["node"].to_numpy()[near_b]
    ids = np.concatenate([a, b])
    if not len(ids):
        return none
    # A node of a tile of one part can be on both sides; it has one rank.
    names, rank = np.unique(ids, return_inverse=True)
    group_of = np.concatenate(roots(links))
    lowest = np.full(len(ids), len(names))
    np.minimum.at(lowest, group_of, rank)
    counted = [links @ right["copies"].to_numpy()[near_b], left["copies"].to_numpy()[near_a] @ links]
    return pd.DataFrame({"node": ids, "links": np.concatenate(counted), "root": names[lowest[group_of]]})


def near_duplicates(vectors: DataFrame, least: float = 0.9, recall: float = 0.999, deviations: float = 4.5, per_cell: int = 1024, tile: int = 4096) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors`` (vec_id, embedding).

    Two rows are linked if their embeddings' cosine is at least ``least``; n_links counts a row's other linked rows,
    component_id is the smallest vec_id reachable and kept marks it. A vector that is null, empty or zero or has a
    null or non-finite component links with nothing, nor do vectors of different dimensions. Repeated rows are
    linked copies. A null vec_id is counted as a copy but heads no component: such a row gets its copies' component,
    or null. Found links are exact, and both ends count them. Of links at the threshold a share of ``recall`` is found
    on average, whatever the dimension, and more of nearer ones; among up to ``per_cell`` vectors, which are
    one cell, only those are missed whose bound fails at ``deviations`` standard errors. Runs jobs that write to the shared folder.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("ok", valid(F.col("embedding")))
    key = [F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2")]
    same = rows.where("ok").select(*key, "vec_id", "embedding").groupBy("k1", "k2")
    nodes = written(same.agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")), "vectors")
    named = nodes.where("node is not null")
    # A row for each dimension in the table.
    sizes = {r["dim"]: r["n"] for r in named.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).collect()}
    axes = {dim: key_axes(n, dim, per_cell) for dim, n in sizes.items()}
    plan = {dim: Placing(keys, *placements(keys, least, recall)) for dim, keys in axes.items()}
    placed = place(named, plan)
    large = placed.groupBy("dim", "cell").agg(F.count("*").alias("n")).where(F.col("n") > tile)
    large = written(large.select("dim", "cell", F.ceil(F.col("n") / tile).cast("int").alias("parts")), "cells")
    cut = placed.join(large, ["dim", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = cut.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("parts", "other")
    at = ["dim", "cell", "i", "j"]
    maybe = written(tiles.groupBy(at).applyInPandas(lambda g: screen(g, plan, least, deviations), "dim int, cell long, i int, j int, part int, node long, before binary"), "candidates")
    whole = maybe.join(named.select("node", "copies", F.col("embedding").cast(stored(named)).alias("embedding")), "node")
    met = written(whole.groupBy(at).applyInPandas(lambda g: meet(g, plan, least, deviations), "node long, links long, root long"), "met")
    found = components(met.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = met.groupBy("node").agg(F.sum("links").alias("links")).join(found, "node", "full")
    known = nodes.select("k1", "k2", "node", "copies").join(linked, "node", "left")
    known = known.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "node").alias("component"))
    out = rows.select("vec_id", *[F.when(F.col("ok"), k).alias(n) for k, n in zip((F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding")), ("k1", "k2"), strict=True)])
    out = out.join(known, ["k1", "k2"], "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
