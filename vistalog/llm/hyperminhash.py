"""Near-duplicate documents by HyperMinHash: compressed registers, banding, estimate, then full sets.

A document's set of hashed word shingles falls into buckets by the hash's first bits. A bucket's register keeps
of its least hash only the number of leading zeros and ten bits after the first one. Bands of registers find
candidates, the share of equal registers, corrected for chance collisions, estimates their similarity, and what
passes is confirmed on full sets.

Steps: equal sets become one class; each class's bands are counted; in each shared band every member meets one
hub, the member that shares most; then members of a band that are still apart meet. In a small band they meet in
pairs. In a large one those outside its largest component meet all members in tiles of bounded rows and bytes, where estimate
and full sets are compared in place and one link for each pair of components comes out. So pairs stay in proportion to
the bands' members, and no link between different texts that share a band is left untested unless both are already
in one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, mix64, slices, written

BUCKETS, ROWS, MANTISSA = 256, 7, 10
BANDS = BUCKETS // ROWS
#: Members up to which a band's pairs are listed, and rows and bytes of sets of either side of a tile.
SMALL, TILE, TILE_BYTES = 12, 1024, 8 << 20
SALTED = 512
_WEIGHT = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BAND_WEIGHT = (mix64(np.arange(1000, 1000 + BUCKETS, dtype=np.uint64)) | np.uint64(1))[: BANDS * ROWS].reshape(BANDS, ROWS)
_BAND_SALT = mix64(np.arange(5000, 5000 + BANDS, dtype=np.uint64))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words.

    A-Z are lower-cased, words are what ASCII white space separates; with fewer words than ``width`` the whole
    sequence is the only shingle; without words the set is empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    if n < width:
        if not n:
            return h
        return mix64(np.array([np.sum(h * _WEIGHT[:n]) + np.uint64(n)], np.uint64))
    total = h[: n - width + 1] * _WEIGHT[0]
    for k in range(1, width):
        total += h[k : n - width + 1 + k] * _WEIGHT[k]
    return np.unique(mix64(total + np.uint64(width)))


def registers(hashes: np.ndarray) -> np.ndarray:
    """A register for each bucket: 0 if empty, else 1 + leading zeros and mantissa bits of its least hash."""
    out = np.zeros(BUCKETS, np.uint16)
    if not len(hashes):
        return out
    bucket = (hashes >> np.uint64(56)).astype(np.int64)
    first = np.append(0, np.flatnonzero(np.diff(bucket)) + 1)
    rest = hashes[first] << np.uint64(8)
    zeros = np.clip(64 - np.frexp(rest.astype(np.float64))[1], 0, 55).astype(np.uint64)
    mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    out[bucket[first]] = ((zeros << np.uint64(MANTISSA)) + mantissa + np.uint64(1)).astype(np.uint16)
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """64-bit keys (document, band). An empty register takes the next filled one's value with its distance, so that
    small sets have whole bands too."""
    rows, cols = np.nonzero(regs)
    at = np.full(regs.shape, 4 * BUCKETS)
    at[rows, cols] = cols
    twice = np.minimum.accumulate(np.concatenate([at, at + BUCKETS], axis=1)[:, ::-1], axis=1)[:, ::-1][:, :BUCKETS]
    far = (twice - np.arange(BUCKETS)).astype(np.uint64)
    full = np.take_along_axis(regs, twice % BUCKETS, 1).astype(np.uint64) + far * np.uint64(1 << 16)
    return mix64((full[:, : BANDS * ROWS].reshape(len(regs), BANDS, ROWS) * _BAND_WEIGHT).sum(2) + _BAND_SALT)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of register rows, less the share of buckets expected to agree by chance."""
    filled = np.maximum(((a > 0) | (b > 0)).sum(1), 1)
    equal = ((a == b) & (a > 0)).sum(1)
    la, lb = na / BUCKETS, nb / BUCKETS
    both, chance = la + lb, np.zeros(len(a))
    for level in range(40):
        top = 2.0**-level
        chance += la * lb / both * (np.exp(-both * top / 2) - np.exp(-both * top)) * top / 2 / (1 << MANTISSA)
    share = equal / filled
    return (share - chance) / (1 - chance)


def sketch(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (the set's identity, null if empty) and registers of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, first, second, regs = [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), width)
                raw = s.tobytes()
                n.append(len(s))
                first.append(int(np.uint64(xxhash.xxh64_intdigest(raw, 1)).astype(np.int64)) if len(s) else None)
                second.append(int(np.uint64(xxhash.xxh64_intdigest(raw, 2)).astype(np.int64)) if len(s) else None)
                regs.append(registers(s).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "set_a", "set_b", "registers"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, registers binary")


def bands(classes: DataFrame) -> DataFrame:
    """rep, n and band for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices([1] * batch.num_rows, 4096):
                part = batch.slice(a, b - a)
                keys = band_keys(np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16).reshape(-1, BUCKETS)).view(np.int64)
                rep = np.repeat(part.column(0).to_numpy(), BANDS)
                n = np.repeat(part.column(1).to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(n), pa.array(keys.ravel())], ["rep", "n", "band"])

    return classes.select("rep", "n", "registers").mapInArrow(run, "rep long, n long, band long")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices([1] * batch.num_rows, 500):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py(), width).tobytes() for t in part.column(1)], pa.binary())], ["rep", "members"])

    return docs.mapInArrow(run, "rep long, members binary")


def likely(pairs: DataFrame, classes: DataFrame, least: float, deviations: float = 5.0) -> DataFrame:
    """Those pairs (a, b) whose estimate is at most ``deviations`` standard errors under ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices([1] * batch.num_rows, 4096):
                part = batch.slice(i, j - i)
                x, y = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint16).reshape(-1, BUCKETS) for k in (4, 5))
                got = estimate(x, y, part.column(2).to_numpy().astype(float), part.column(3).to_numpy().astype(float))
                good = got >= _margin(((x > 0) | (y > 0)).sum(1), least, deviations)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(good)), part.column(1).filter(pa.array(good))], ["a", "b"])

    side = lambda k: classes.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("registers").alias(f"r_{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) for which 100 x intersection is at least ``percent`` x union, on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                inter = int((t[np.minimum(at, len(t) - 1)] == s).sum())
                good.append(100 * inter >= percent * (len(s) + len(t) - inter))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    side = lambda k: sets.select(F.col("rep").alias(k), F.col("members").alias(f"s_{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def _margin(filled: np.ndarray, least: float, deviations: float) -> np.ndarray:
    return least - deviations * np.sqrt(least * (1 - least) / np.maximum(filled, 1))


def meet(group: pd.DataFrame, percent: int, deviations: float = 5.0) -> pd.DataFrame:
    """Links (a, b) between components that a tile's rows show: ``asks`` rows against the others.

    A pair is looked at in the first band that it shares only, and not once its components are joined by a link found
    before. Rows have band, rep, n, at (component), registers, members (set) and asks.
    """
    asks, told = group[group["asks"]], group[~group["asks"]]
    if not len(asks) or not len(told):
        return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
    matrix = lambda rows: np.frombuffer(b"".join(rows["registers"].tolist()), np.uint16).reshape(-1, BUCKETS)
    x, y = matrix(asks), matrix(told)
    key_x, key_y = band_keys(x), band_keys(y)
    band = np.uint64(np.int64(group["band"].iloc[0]).astype(np.uint64))
    rep_x, rep_y, n_x, n_y = asks["rep"].to_numpy(), told["rep"].to_numpy(), asks["n"].to_numpy(), told["n"].to_numpy()
    sets = [np.frombuffer(v, np.uint64) for v in [*asks["members"], *told["members"]]]
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    offset = np.concatenate([[0], np.cumsum([len(v) for v in sets])])
    asked, marked = set(rep_x.tolist()), np.zeros(len(known), bool)
    both = np.array([r in asked for r in rep_y.tolist()])
    names, place = np.unique(np.concatenate([asks["at"].to_numpy(), told["at"].to_numpy()]), return_inverse=True)
    group_of = np.arange(len(names))
    at_y, out = place[len(asks) :], []
    column = (key_y == band).argmax(1)
    for i in range(len(asks)):
        mine = group_of[place[i]]
        size_ok = 100 * np.minimum(n_x[i], n_y) >= percent * np.maximum(n_x[i], n_y)
        todo = np.flatnonzero(size_ok & (group_of[at_y] != mine) & (~both | (rep_x[i] < rep_y)))
        todo = todo[(key_x[i] == key_y[todo]).argmax(1) == column[todo]]
        if not len(todo):
            continue
        near, other = y[todo], np.broadcast_to(x[i], (len(todo), BUCKETS))
        got = estimate(other, near, np.full(len(todo), float(n_x[i])), n_y[todo].astype(float))
        good = got >= _margin(((near > 0) | (other > 0)).sum(1), percent / 100, deviations)
        todo = todo[good][np.argsort(-got[good], kind="stable")]
        own = flat[offset[i] : offset[i + 1]]
        marked[own] = True
        while len(todo):
            now, todo = todo[:64], todo[64:]
            spans = [flat[offset[len(asks) + j] : offset[len(asks) + j + 1]] for j in now.tolist()]
            inter = np.add.reduceat(marked[np.concatenate(spans)].astype(np.int64), np.concatenate([[0], np.cumsum([len(v) for v in spans])[:-1]]))
            linked = 100 * inter >= percent * (n_x[i] + n_y[now] - inter)
            for j in now[linked].tolist():
                if (theirs := group_of[at_y[j]]) != group_of[place[i]]:
                    out.append((rep_x[i], rep_y[j]))
                    group_of[group_of == theirs] = group_of[place[i]]
            todo = todo[group_of[at_y[todo]] != group_of[place[i]]]
        marked[own] = False
    return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])


def _by_band(rows: DataFrame, one: DataFrame, how: str = "inner") -> DataFrame:
    """Join of ``rows`` (band, rep, size) with at most one row of ``one`` for each band, which has the band's size too.

    Rows of a large band are dealt over several tasks by a salt, and that band's row of ``one`` is copied to each.
    """
    salts = F.ceil(F.col("size") / SALTED).cast("int")
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("rep"), salts).cast("int"))
    copied = one.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("size")
    return dealt.join(copied, ["band", "salt"], how).drop("salt")


def _met_in_tiles(large: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found between the rows of ``large`` (band, rep, n, at, size) that are apart."""
    by_part = large.groupBy("band", "at").agg(F.count("*").alias("c"), (8 * F.sum("n")).alias("b"), F.max("size").alias("size"))
    most = by_part.groupBy("band").agg(F.max(F.struct("c", (-F.col("at")).alias("neg"), "b")).alias("m"), F.sum("c").alias("all"), F.sum("b").alias("bytes"), F.max("size").alias("size"))
    parts = lambda n, b: F.greatest(F.lit(1), F.ceil(n / TILE), F.ceil(b / TILE_BYTES)).cast("int")
    sized = most.select("band", (-F.col("m.neg")).alias("main"), "size", parts(F.col("all") - F.col("m.c"), F.col("bytes") - F.col("m.b")).alias("n_i"), parts(F.col("all"), F.col("bytes")).alias("n_j"))
    rows = _by_band(large, sized).join(classes.select("rep", "registers"), "rep").join(sets, "rep")
    part = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "rep"), F.col(n)).cast("int")
    columns = ["band", "i", "j", "rep", "n", "at", "registers", "members"]
    asks = rows.where("at <> main").withColumn("i", part(1, "n_i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_j") - 1))).select(*columns, F.lit(True).alias("asks"))
    told = rows.withColumn("j", part(2, "n_j")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_i") - 1))).select(*columns, F.lit(False).alias("asks"))
    return asks.union(told).groupBy("band", "i", "j").applyInPandas(lambda g: meet(g, percent), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text).

    Documents are linked whose sets of ``width``-word shingles have 100 x intersection >= ``percent`` x union.
    component_id is the smallest doc_id reachable by links, kept is true for it. A null or empty text, or one
    without words, has an empty set and is linked with nothing. Rows with equal sets are linked; rows that repeat
    a doc_id are one node. A row with a null doc_id gets the component of its set's other rows, else null, and is
    not kept. An empty table gives an empty one; other columns are ignored. Runs jobs that write to the shared folder.
    """
    bounded_batches(docs.sparkSession)
    sketched = written(sketch(docs, width), "sketches")
    keyed = sketched.where("doc_id is not null and n_shingles > 0")
    classes = keyed.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "n_shingles", "registers")).alias("r"), F.count("*").alias("copies"))
    classes = written(classes.select("set_a", "set_b", "copies", F.col("r.doc_id").alias("rep"), F.col("r.n_shingles").alias("n"), F.col("r.registers").alias("registers")), "classes")
    every = bands(classes)
    # Written first, so that the join has two plain shuffles, of which Spark splits a partition that one band makes large.
    counts = written(every.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "counts")
    shared = written(every.join(counts, "band"), "bands")

    similar = f"100 * least(n_a, n_b) >= {int(percent)} * greatest(n_a, n_b)"
    reach = shared.groupBy("rep").agg(F.sum("size").alias("reach"))
    hub = shared.join(reach, "rep").groupBy("band").agg(F.max(F.struct("reach", (-F.col("rep")).alias("neg"), "n")).alias("h"), F.max("size").alias("size"))
    hub = hub.select("band", "size", (-F.col("h.neg")).alias("hub"), F.col("h.n").alias("n_b"))
    met = _by_band(shared.withColumnRenamed("n", "n_a"), hub).where("rep <> hub").where(similar)
    pairs = written(met.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct(), "pairs")

    needed = shared.where("size > 1").select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = written(_sets(texts.join(needed, "doc_id", "left_semi").select("doc_id", "text"), width).distinct(), "sets")
    least = percent / 100
    first = confirmed(likely(pairs, classes, least), sets, percent).checkpoint()

    so_far = components(first)
    placed = shared.where("size > 2").join(so_far.select(F.col("node").alias("rep"), "component"), "rep", "left").select("band", "rep", "n", "size", F.coalesce("component", "rep").alias("at"))
    apart = placed.groupBy("band").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.max("size").alias("size")).where("low < high").select("band", "size")
    placed = written(_by_band(placed, apart, "left_semi"), "apart")
    few = placed.where(F.col("size") <= SMALL)
    x, y = (few.select("band", F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("at").alias(f"at_{k}")) for k in ("a", "b"))
    more = x.join(y, "band").where("a < b and at_a <> at_b").where(similar).select("a", "b").distinct()
    more = more.join(pairs, ["a", "b"], "left_anti")
    second = confirmed(likely(written(more, "more"), classes, least), sets, percent).checkpoint()
    third = _met_in_tiles(placed.where(F.col("size") > SMALL), classes, sets, percent).checkpoint()
    found = components(first.union(second).union(third))

    groups = classes.select("set_a", "set_b", "copies", "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").where("copies > 1 or component is not null")
    groups = groups.select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    out = sketched.select("doc_id", "n_shingles", "set_a", "set_b").join(groups, ["set_a", "set_b"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 85) -> DataFrame:
    """The rows of ``docs``, with all their columns, that near_duplicates() keeps: one document of each group.

    Rows that repeat both doc_id and text are one document; rows without a doc_id, of which none can be named, stay.
    """
    kept = near_duplicates(docs, width, percent).where("kept").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.where("doc_id is null"))
