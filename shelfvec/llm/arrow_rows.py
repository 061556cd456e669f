"""Arrow helpers for functions that run inside tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shelfvec.sources.shipping import ensure_shipped


def texts_of(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(name).to_pylist()


def list_column(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """One list per part, without a Python object per element."""
    offsets = np.zeros(len(parts) + 1, dtype="int32")
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], names: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The columns ``names`` of each run of rows with equal keys, one run in memory at a time.

    The rows are sorted by key; a run may go on in the next batch.
    """
    open_key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
        cuts = [0, *[i for i in range(1, len(rows)) if rows[i] != rows[i - 1]], len(rows)]
        wanted = batch.select(names)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if parts and rows[a] != open_key:
                yield open_key, pa.Table.from_batches(parts)
                parts = []
            open_key = rows[a]
            parts.append(wanted.slice(a, b - a))
    if parts:
        yield open_key, pa.Table.from_batches(parts)


def running_digests(pieces: DataFrame, separator: str = "\n") -> DataFrame:
    """``key, sha256`` of each key's ``piece`` texts, joined in the order of ``segment``; one piece in memory."""
    ensure_shipped(pieces.sparkSession)
    between = separator.encode()
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, state = None, None
        for batch in batches:
            done = []
            for key, piece in zip(batch.column("key").to_pylist(), batch.column("piece"), strict=True):
                if state is None or key != open_key:
                    if state is not None:
                        done.append((open_key, state.hexdigest()))
                    open_key, state = key, hashlib.sha256()
                else:
                    state.update(between)
                state.update(piece.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], names=schema.names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (open_key, state.hexdigest())], names=schema.names)

    return pieces.repartition("key").sortWithinPartitions("key", "segment").mapInArrow(run, schema)
