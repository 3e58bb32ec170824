"""Order-dependent folds: state that passes from row to row of a key, for greedy rules that no window can express."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "struct<frame_id:string,frame_us:long>": pa.struct([("frame_id", pa.string()), ("frame_us", pa.int64())])}


def sorted_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], inputs: Sequence[str], start: Callable[[], Callable], name: str, kind: str) -> DataFrame:
    """``df`` with column ``name``: for each row what the key's step function, made by ``start``, returns for its inputs.

    Rows are partitioned by the keys and sorted in each partition, so the fold streams: it holds a batch and one key's
    state, however many rows the key has.
    """
    keys, inputs = list(keys), list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in keys + inputs]
            out = []
            for row in zip(*columns, strict=True):
                if step is None or row[: len(keys)] != now:
                    now, step = row[: len(keys)], start()
                out.append(step(*row[len(keys) :]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, _ARROW[kind])], [*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, f"{fields}, `{name}` {kind}")


def key_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where a new key begins in sorted rows; the first row begins one."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        column = table.column(k).combine_chunks()
        new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return new


def whole_keys(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of sorted rows in which all rows of a key are together; a batch and one key's rows are held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows = pa.Table.from_batches(held[-1:] if len(held) == 1 else [*held[-2:]])
        starts = np.flatnonzero(key_starts(rows, keys))
        last = int(starts[-1]) - (rows.num_rows - batch.num_rows)
        if last > 0 or (len(held) > 1 and last == 0):
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, last)]).combine_chunks()
            held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
