"""Principal components of wide vectors, without a matrix of width by width.

The leading axes are found in a growing subspace: a block of orthonormal
directions, a few more than are wanted, goes through the rows once per round.
Each task multiplies its rows with the block and that product back, which is
width by directions, and these partial products are added up on the executors.
The driver keeps the last few blocks with their products, solves the small
eigenproblem inside them, and takes what the best axes still lack as the next
block. So a handful of rounds does what many do that keep one block only. It
ends when the axes no longer turn, or when the blocks fill the whole space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfvec.operators.lockstep import DIRECT_PARTS
from shelfvec.sources.scratch import materialize
from shelfvec.sources.shipping import ensure_shipped

# Directions beyond the wanted ones, rounds at most, turn that counts as none, blocks kept.
EXTRA = 16
ROUNDS = 300
TURN = 1e-7
KEPT_BLOCKS = 6

PARTS = "part int, rows long, load binary"


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8", copy=False).reshape(rows, -1)


def _sums(rows: DataFrame, make, *shared) -> tuple[int, np.ndarray]:
    """Row count and the sum of ``make(matrix, *shared)`` over all batches of the column ``x``."""
    spark = rows.sparkSession
    ensure_shipped(spark)
    sent = spark.sparkContext.broadcast(shared)

    def packed(count: int, total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        if total is not None:
            load = total.astype("f8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([count]), pa.array([load], pa.binary())], names=["part", "rows", "load"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, None
        for batch in batches:
            if batch.num_rows:
                piece = make(_matrix(batch.column("x"), batch.num_rows), *sent.value)
                total = piece if total is None else total + piece
                count += batch.num_rows
        yield from packed(count, total)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, None
        for batch in batches:
            for n, load in zip(batch.column("rows").to_pylist(), batch.column("load").to_pylist(), strict=True):
                piece = np.frombuffer(load, "f8")
                total = piece if total is None else total + piece
                count += n
        yield from packed(count, total)

    parts = rows.rdd.getNumPartitions()
    found = rows.mapInArrow(partial, PARTS)
    while parts > DIRECT_PARTS:
        parts = max(DIRECT_PARTS, parts // DIRECT_PARTS)
        found = found.repartition(parts).mapInArrow(added, PARTS)
    count, total = 0, None
    # One job for all partitions; an iterator would run them one after the other.
    for row in found.collect():
        piece = np.frombuffer(row["load"], "f8")
        total = piece if total is None else total + piece
        count += row["rows"]
    sent.destroy()
    return count, np.zeros(0) if total is None else total


def moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, mean and population deviation of each component of ``x``."""
    n, first = _sums(rows, lambda x: x.sum(axis=0))
    if not n:
        return 0, first, first
    mean = first / n
    _, second = _sums(rows, lambda x, m: ((x - m) ** 2).sum(axis=0), mean)
    return n, mean, np.sqrt(second / n)


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return (x - mean) * scale


def _beside(basis: np.ndarray, wanted: np.ndarray, least: float) -> np.ndarray:
    """Orthonormal directions of ``wanted`` that lie outside ``basis``; those of less than ``least`` left out."""
    # Twice, as the first pass leaves rounding errors of the size of what it took away.
    for _ in range(2):
        wanted = wanted - basis @ (basis.T @ wanted)
        left, sizes, _ = np.linalg.svd(wanted, full_matrices=False)
        wanted = left[:, sizes > least]
        wanted = wanted[:, : basis.shape[0] - basis.shape[1]]
        least = 0.1
    return np.linalg.qr(wanted - basis @ (basis.T @ wanted))[0]


def leading_axes(
    rows: DataFrame, components: int, extra: int = EXTRA, rounds: int = ROUNDS, turn: float = TURN, seed: int = 42
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean, factor, axes (width by components) and variances of the standardised array column ``x``.

    ``rows`` is read once per round and should be stored. Memory in a task is
    that of width by ``components + extra`` numbers, on the driver ``KEPT_BLOCKS``
    times that. A constant component is zero after scaling. Signs make each axis'
    largest entry positive.
    """
    n, mean, deviation = moments(rows)
    width = len(mean)
    scale = np.divide(1.0, deviation, out=np.zeros(width), where=deviation > 1e-12 * (1 + np.abs(mean)))
    k = min(components, width)
    if not n or not k:
        return mean, scale, np.zeros((width, 0)), np.zeros(0)
    size = min(width, k + extra)
    block, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))
    basis, images = np.zeros((width, 0)), np.zeros((width, 0))
    for _ in range(rounds):
        _, flat = _sums(rows, lambda x, q, m, s: (lambda z: z.T @ (z @ q))(_scaled(x, m, s)).ravel(), block, mean, scale)
        basis = np.hstack([basis, block])
        images = np.hstack([images, flat.reshape(width, -1) / n])
        inside = basis.T @ images
        values, inner = np.linalg.eigh((inside + inside.T) / 2)
        order = np.argsort(values)[::-1][:size]
        values, inner = values[order], inner[:, order]
        best, lacks = basis @ inner, images @ inner
        axes = best[:, :k]
        lacks = lacks - best * values
        if np.abs(lacks[:, :k]).max(initial=0.0) <= turn * max(values[0], 1e-300) or basis.shape[1] >= width:
            break
        if basis.shape[1] + size > KEPT_BLOCKS * size:
            basis, images = best, images @ inner
        block = _beside(basis, lacks, 1e-14 * max(values[0], 1e-300))
        if not block.shape[1]:
            break
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    return mean, scale, axes * signs, values[:k]


def reduce_wide(df: DataFrame, column: str, output: str, components: int, **options) -> DataFrame:
    """``reduce_dimensions`` for vectors too wide for a covariance matrix on the driver."""
    rows = materialize(df.select(vector_to_array(column).alias("x")), "wide-vectors")
    mean, scale, axes, _ = leading_axes(rows, components, **options)
    sent = df.sparkSession.sparkContext.broadcast((mean, scale, axes))

    @F.arrow_udf("array<double>")
    def projected(values: pa.Array) -> pa.Array:
        mean, scale, axes = sent.value
        n = len(values)
        out = (_scaled(_matrix(values, n), mean, scale) @ axes) if n else np.zeros((0, axes.shape[1]))
        offsets = pa.array(np.arange(n + 1, dtype="i4") * axes.shape[1])
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

    return df.withColumn(output, array_to_vector(projected(vector_to_array(column))))
