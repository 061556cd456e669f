"""Vector concatenation, normalisation and batch-wise similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfvec.functions.text import as_column
from shelfvec.operators.numbering import batch_of
from shelfvec.sources.shipping import ensure_shipped

# Fixed value: default logit scale, e ** 1.
LOGIT_SCALE = float(np.e)


def concat_vectors(text: Column | str = "text", img: Column | str = "img") -> Column:
    return F.concat(as_column(text), as_column(img))


def l2_normalize(vector: Column | str) -> Column:
    """The vector divided by its Euclidean length; a zero vector gives NaN.

    One numpy pass per Arrow batch: an SQL lambda would be interpreted
    element by element.
    """

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def unit(vectors: pa.Array) -> pa.Array:
        offsets = vectors.offsets.to_numpy()
        first, last = offsets[0], offsets[-1]
        values = vectors.values.to_numpy(zero_copy_only=False)[first:last].astype(np.float64)
        widths = np.diff(offsets)
        filled = widths > 0
        norms = np.ones(len(widths))
        if filled.any():
            starts = (offsets[:-1] - first)[filled]
            norms[filled] = np.sqrt(np.add.reduceat(values * values, starts))
        with np.errstate(invalid="ignore", divide="ignore"):
            scaled = values / np.repeat(norms, widths)
        return pa.ListArray.from_arrays(
            pa.array(offsets - first, pa.int32()), pa.array(scaled), mask=vectors.is_null()
        )

    return unit(as_column(vector))


def _collected(df: DataFrame, size: int, text: str, img: str, key: str) -> DataFrame:
    """One row per batch with its members in order.

    Positions are unique, so a batch has at most ``size`` members, whatever
    the data; a table with repeated positions is refused.
    """
    member = F.struct(
        F.col(key).cast("long").alias("row_id"), F.col(text).alias("text"), F.col(img).alias("img")
    )
    grouped = (
        df.select(batch_of(size, key).alias("batch_id"), member.alias("member"))
        .groupBy("batch_id")
        .agg(F.sort_array(F.collect_list("member")).alias("members"))
    )
    fits = F.size("members") <= size
    message = F.lit(f"more than {size} rows in a batch: positions are not unique")
    return grouped.where(F.when(fits, True).otherwise(F.raise_error(message).cast("boolean")))


def _unit_matrix(vectors: pa.ListArray, rows: int) -> np.ndarray:
    matrix = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _batches(
    batches: Iterator[pa.RecordBatch],
) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """Batch id, row ids, unit image matrix and unit text matrix of each batch."""
    for batch in batches:
        for batch_id, members in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows = members.values
            count = len(rows)
            yield (
                batch_id,
                rows.field("row_id"),
                _unit_matrix(rows.field("img"), count),
                _unit_matrix(rows.field("text"), count),
            )


def batch_logits(
    df: DataFrame,
    batch_size: int,
    logit_scale: float = LOGIT_SCALE,
    text: str = "text",
    img: str = "img",
    key: str = "row_id",
) -> DataFrame:
    """Scaled cosine of every image with every text of its batch.

    One output row per input row: ``logits_per_image`` holds its image against
    the batch's texts, ``logits_per_text`` its text against the images, both in
    row order. The work is one small matrix product per batch.
    """
    ensure_shipped(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch_id, ids, images, texts in _batches(batches):
            logits = logit_scale * images @ texts.T
            count = len(ids)
            offsets = pa.array(np.arange(0, count * count + 1, count, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch_id] * count, pa.int64()),
                    ids,
                    pa.ListArray.from_arrays(offsets, pa.array(logits.ravel())),
                    pa.ListArray.from_arrays(offsets, pa.array(logits.T.ravel())),
                ],
                names=["batch_id", "row_id", "logits_per_image", "logits_per_text"],
            )

    schema = (
        "batch_id long, row_id long, logits_per_image array<double>, logits_per_text array<double>"
    )
    return _collected(df, batch_size, text, img, key).mapInArrow(run, schema)


def contrastive_loss(
    df: DataFrame,
    batch_size: int,
    logit_scale: float = LOGIT_SCALE,
    text: str = "text",
    img: str = "img",
    key: str = "row_id",
) -> DataFrame:
    """Per batch, the mean cross-entropy against the diagonal, both ways and averaged."""
    ensure_shipped(df.sparkSession)

    def cross_entropy(logits: np.ndarray) -> float:
        top = logits.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(logits - top).sum(axis=1))
        return float(np.mean(total - np.diag(logits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch_id, ids, images, texts in _batches(batches):
            logits = logit_scale * images @ texts.T
            by_image, by_text = cross_entropy(logits), cross_entropy(logits.T)
            yield pa.RecordBatch.from_pydict(
                {
                    "batch_id": pa.array([batch_id], pa.int64()),
                    "n": pa.array([len(ids)], pa.int64()),
                    "image_loss": pa.array([by_image]),
                    "text_loss": pa.array([by_text]),
                    "loss": pa.array([(by_image + by_text) / 2]),
                }
            )

    schema = "batch_id long, n long, image_loss double, text_loss double, loss double"
    return _collected(df, batch_size, text, img, key).mapInArrow(run, schema)
