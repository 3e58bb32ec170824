"""Selections that cover many values: quotas over several keys, and k centres by max-min distance."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import written


def balanced(candidates: DataFrame, k: int, keys: Sequence[str], weight: Column | None = None, id_column: str = "scene_id", score: str = "score") -> DataFrame:
    """The ``k`` best rows under quotas for the values of ``keys``, with their place in ``chosen_rank``.

    The j-th best row of a group with weight w comes at (2j - 1) / w, so that quotas follow the weights, and what a small group
    cannot fill goes to the others in the same proportion. A null value of a key is one of its own, a null score comes last, ties
    go to the smaller id, and groups whose weight is null or not positive are left out. Only a group's first ``k`` rows are
    ranked, which Spark cuts before it shuffles, so a hot group costs no more than others.
    """
    best = (F.col(score).desc_nulls_last(), F.col(id_column))
    placed = candidates.withColumn("_w", (F.lit(1.0) if weight is None else weight).cast("double")).where("_w > 0")
    placed = placed.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).where(F.col("_n") <= k)
    turn = (F.col("_n") * 2 - 1) / F.col("_w")
    # At most k rows are left for the window without a key.
    first = placed.withColumn("_turn", turn).orderBy("_turn", *best).limit(k)
    return first.withColumn("chosen_rank", F.row_number().over(Window.orderBy("_turn", *best)).cast("long")).drop("_w", "_n", "_turn")


def _distances(x: np.ndarray, marks: np.ndarray, to_x: np.ndarray, to_marks: np.ndarray) -> np.ndarray:
    """Squared distance of each row to the nearest of some centres; infinite without any."""
    out = np.full(len(x), np.inf)
    for c, m in zip(to_x, to_marks, strict=True):
        d = np.zeros(len(x))
        for f in range(x.shape[1]):
            d += (x[:, f] - c[f]) ** 2
        for f in range(marks.shape[1]):
            d += marks[:, f] != m[f]
        np.minimum(out, d, out=out)
    return out


def _order(d: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Indexes, farthest first, then by score and id."""
    return np.lexsort((ids, -score, -d))


def _columns(batch: pa.RecordBatch, n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    take = lambda a, b, kind: np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(kind) for i in range(a, b)], 1) if b > a else np.zeros((batch.num_rows, 0), kind)
    return np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy(zero_copy_only=False), take(2, 2 + n, float), take(2 + n, 2 + n + m, np.int64)


def k_centres(candidates: DataFrame, k: int, features: Mapping[str, float], keys: Sequence[str] = (), id_column: str = "scene_id", score: str = "score", batch: int = 1024) -> DataFrame:
    """``k`` rows that lie far apart, with chosen_rank from 1 and distance, the squared one to the nearest row chosen before.

    The first row has the best score; each next one is farthest from all chosen, ties by score, then by the smaller id. Squared
    distances add up the squares of the differences of ``features`` (column to factor) and 1 for each of ``keys`` that differs. A
    feature that is null or not finite counts as 0, a null key as a value, a null or NaN score comes last. Rows with a null
    id are never chosen, and of rows with one id at most one. Fewer rows than ``k`` are all chosen; the first has a null distance.

    The choice is the greedy one exactly, at any size. A pass over the rows keeps the ``batch`` farthest of each task, and of all of
    them those of the table come to the driver. Among these it goes on choosing while the next is no nearer than the last of the batch was,
    since distances of the rows outside can only shrink. So the driver holds ``batch`` and ``k`` rows, there are ``k`` passes at
    most, over a narrow table that is written once, and no pass shuffles more than ``batch`` rows a task.
    """
    n, m = len(features), len(keys)
    finite = lambda c: F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)
    # Passes and the last join read one table, so what leads to the candidates is done once.
    candidates = written(candidates, "candidates")
    value, own = F.col(score).cast("double"), F.col(id_column).cast("string").alias("id")
    narrow = [finite(F.col(c).cast("double") * float(s)).alias(f"f{i}") for i, (c, s) in enumerate(features.items())]
    narrow += [F.xxhash64(F.lit(i), F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(keys)]
    rows = written(candidates.where(F.col(id_column).isNotNull()).select(own, F.when(value.isNull() | F.isnan(value), float("-inf")).otherwise(value).alias("s"), *narrow), "centres")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", d double"
    chosen: list[tuple] = []
    taken: set[str] = set()

    def farthest(at_x: np.ndarray, at_marks: np.ndarray, gone: set[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = None
            for b in batches:
                ids, s, x, marks = _columns(b, n, m)
                d = pa.array(_distances(x, marks, at_x, at_marks))
                both = b.append_column("d", d).filter(pa.array([i not in gone for i in ids], pa.bool_()))
                both = both if kept is None else pa.concat_batches([kept, both])
                first = _order(both.column("d").to_numpy(), both.column("s").to_numpy(), np.array(both.column("id").to_pylist(), object))[:batch]
                kept = both.take(pa.array(first))
            if kept is not None:
                yield kept

        return run

    while len(chosen) < k:
        at_x = np.array([c[2] for c in chosen], float).reshape(len(chosen), n)
        at_marks = np.array([c[3] for c in chosen], np.int64).reshape(len(chosen), m)
        seen = rows.mapInArrow(farthest(at_x, at_marks, set(taken)), kinds)
        near = seen.orderBy(F.col("d").desc(), F.col("s").desc(), "id").limit(batch).toArrow().combine_chunks()
        if not near.num_rows:
            break
        ids, s, x, marks = _columns(near.to_batches()[0], n, m)
        d = near.column("d").to_numpy().copy()
        last = (-d[-1], -s[-1], ids[-1]) if len(ids) == batch else None
        free = np.ones(len(ids), bool)
        while len(chosen) < k and free.any():
            left = np.flatnonzero(free)
            i = left[_order(d[left], s[left], ids[left])[0]]
            if last is not None and (-d[i], -s[i], ids[i]) > last:
                break
            chosen.append((ids[i], None if np.isinf(d[i]) else float(d[i]), x[i], marks[i], float(s[i])))
            taken.add(ids[i])
            free &= ids != ids[i]
            d = np.minimum(d, _distances(x, marks, x[i : i + 1], marks[i : i + 1]))
            if len(chosen) == 1 and last is not None:
                break
    picks = candidates.sparkSession.createDataFrame([(c[0], i + 1, c[1], c[4]) for i, c in enumerate(chosen)], "_id string, chosen_rank long, distance double, _s double")
    # k rows, a parameter. Of rows with one id, that of the chosen score counts.
    out = candidates.join(F.broadcast(picks), own.eqNullSafe(F.col("_id"))).where(F.when(value.isNull() | F.isnan(value), float("-inf")).otherwise(value) == F.col("_s"))
    return out.dropDuplicates(["_id"]).drop("_id", "_s")
