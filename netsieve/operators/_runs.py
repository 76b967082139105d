"""Sorted partition walks over Arrow batches, one run of equal keys after the other.

Columns that only pass through stay Arrow arrays from end to end, so nothing
about them changes (a BIGINT with NULLs keeps all its digits); only the columns
a step reads become numpy arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_ARROW = {T.LongType(): pa.int64(), T.BooleanType(): pa.bool_(), T.StringType(): pa.string(), T.DoubleType(): pa.float64(),
          T.IntegerType(): pa.int32(), T.TimestampNTZType(): pa.timestamp("us"), T.TimestampType(): pa.timestamp("us", "UTC")}


class Columns(dict):
    """numpy arrays of a batch, converted when first asked for."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch

    def __missing__(self, name: str) -> np.ndarray:
        self[name] = a = self.batch.column(name).to_numpy(zero_copy_only=False)
        return a


def _changed(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two columns differ, NULL being equal to NULL."""
    differs = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(differs, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def key_changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Boolean per row: does it start a run of equal keys?"""
    out = np.zeros(batch.num_rows, bool)
    if batch.num_rows:
        out[0] = True
        for k in keys:
            c = batch.column(k)
            out[1:] |= _changed(c.slice(1), c.slice(0, len(c) - 1))
    return out


def to_arrow(values, kind: T.DataType) -> pa.Array:
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return pa.array(np.asarray(values, np.int64)).cast(_ARROW[kind])
    return pa.array(values, _ARROW[kind], from_pandas=False)


def keyed_scan(df: DataFrame, keys: list[str], order: list[str], make_state: Callable[[], dict], step: Callable,
               out_fields: list[tuple[str, T.DataType, str]], num_partitions: int | None = None) -> DataFrame:
    """Walk every key's rows in ``order`` and add columns.

    ``step(state, cols, s, e, out)`` handles rows ``s:e`` of one key: ``cols``
    gives a numpy array per column of the batch, ``out`` has one preallocated
    array per output. ``state`` lives on while the key's rows do."""
    x = df.repartition(num_partitions, *keys) if num_partitions else df.repartition(*keys)
    x = x.sortWithinPartitions(*keys, *order)
    names = list(df.columns)
    schema = T.StructType(df.schema.fields + [T.StructField(n, t) for n, t, _ in out_fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cols, out = Columns(batch), {name: np.empty(n, dtype=dt) for name, _, dt in out_fields}
            starts = np.flatnonzero(key_changes(batch, keys)).tolist()
            for s, e in zip(starts, starts[1:] + [n]):
                key = tuple(batch.column(k)[s].as_py() for k in keys)
                if key != current:
                    current, state = key, make_state()
                step(state, cols, s, e, out)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(to_arrow(out[f], t) for f, t, _ in out_fields)],
                                             names=names + [f for f, _, _ in out_fields])

    return x.mapInArrow(run, schema)


def group_runs(df: DataFrame, keys: list[str], order: list[str], fn: Callable, inputs: list[str], keep: list[str],
               out_fields: list[tuple[str, T.DataType]]) -> DataFrame:
    """Apply ``fn`` to every complete group of equal ``keys``, rows in ``order``.

    ``fn(arrays) -> (rows, new)`` gets numpy arrays of ``inputs`` for one group
    and returns which of its rows go on (indices, None for all) and, for each of
    them, values of ``out_fields``. Parts of a group that Arrow batches cut are
    kept as they are and put together once."""
    x = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in out_fields])

    def emit(batch: pa.RecordBatch, starts: list[int]) -> pa.RecordBatch:
        arrays = Columns(batch)
        rows, new = [], {n: [] for n, _ in out_fields}
        for s, e in zip(starts, starts[1:] + [batch.num_rows]):
            take, values = fn({c: arrays[c][s:e] for c in inputs})
            rows.append(np.arange(s, e) if take is None else s + np.asarray(take, np.int64))
            for n, v in values.items():
                new[n].append(v)
        pick = batch.select(keep).take(pa.array(np.concatenate(rows)))
        return pa.RecordBatch.from_arrays([*pick.columns, *(to_arrow(np.concatenate(new[n]), t) for n, t in out_fields)],
                                          names=keep + [n for n, _ in out_fields])

    def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = key_changes(batch, keys)
            if pending:
                last = pending[-1].slice(pending[-1].num_rows - 1)
                new[0] = any(_changed(last.column(k), batch.column(k).slice(0, 1))[0] for k in keys)
            starts = np.flatnonzero(new).tolist()
            if not starts:
                pending.append(batch)
                continue
            if starts[0]:
                pending.append(batch.slice(0, starts[0]))
            if pending:
                yield emit(whole(pending), [0])
            first, last = starts[0], starts[-1]
            if last > first:
                yield emit(batch.slice(first, last - first), [s - first for s in starts[:-1]])
            pending = [batch.slice(last)]
        if pending:
            yield emit(whole(pending), [0])

    return x.mapInArrow(run, schema)
