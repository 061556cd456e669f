"""Batch inference: two vectors per row from a user-supplied encoder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfvec.sources.shipping import ensure_shipped


class Encoder(Protocol):
    """What runs inside a Python worker. Both methods return one row per value."""

    def text(self, values: Sequence[Any]) -> np.ndarray: ...

    def image(self, values: Sequence[Any]) -> np.ndarray: ...


# One loaded encoder per Python worker, by the token of the encode call.
_loaded: dict[str, Encoder] = {}


def _encoder(token: str, factory: Callable[[], Encoder]) -> Encoder:
    if token not in _loaded:
        _loaded[token] = factory()
    return _loaded[token]


def _values(column: pa.Array) -> list:
    """Numeric lists as numpy arrays, pictures as H x W x 3 arrays, the rest as is."""
    if pa.types.is_list(column.type):
        return [value.values.to_numpy(zero_copy_only=False) for value in column]
    if pa.types.is_struct(column.type):
        return [
            np.frombuffer(p["data"], dtype=np.uint8).reshape(p["height"], p["width"], 3)
            for p in column.to_pylist()
        ]
    return column.to_pylist()


def _list_array(matrix: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    rows, width = matrix.shape
    offsets = np.arange(0, (rows + 1) * width, width, dtype=np.int32) if width else [0] * (rows + 1)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(matrix.ravel(), kind))


def encode(
    df: DataFrame,
    factory: Callable[[], Encoder],
    text: str = "title",
    image: str = "picture",
    key: str = "row_id",
    batch_size: int = 10,
    element: str = "float",
) -> DataFrame:
    """``key, text, img`` for every row.

    ``factory`` builds the encoder in the worker and must be picklable. Rows
    are encoded where they are; the key travels with its row, so the result
    does not depend on partitioning. Only the three columns named here cross
    to Python, in transfers that ``spark.sql.execution.arrow.maxBytesPerBatch``
    keeps small even when rows carry pictures.
    """
    sides = {"text": (text, "text"), "img": (image, "image")}
    return _encoded(df, factory, sides, key, batch_size, element)


def encode_one(
    df: DataFrame,
    factory: Callable[[], Encoder],
    side: str,
    column: str,
    key: str = "row_id",
    batch_size: int = 10,
    element: str = "float",
) -> DataFrame:
    """``key, text`` or ``key, img``: one side of ``encode``, where that side's rows lie."""
    method = {"text": "text", "img": "image"}[side]
    return _encoded(df, factory, {side: (column, method)}, key, batch_size, element)


def _encoded(
    df: DataFrame,
    factory: Callable[[], Encoder],
    sides: dict[str, tuple[str, str]],
    key: str,
    batch_size: int,
    element: str,
) -> DataFrame:
    ensure_shipped(df.sparkSession)
    token = uuid.uuid4().hex
    kind = pa.float64() if element == "double" else pa.float32()
    methods = [method for _, method in sides.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(token, factory)
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                coded = [
                    _list_array(np.asarray(getattr(encoder, method)(_values(part.column(i)))), kind)
                    for i, method in enumerate(methods, start=1)
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), *coded], names=["row_id", *sides])

    inputs = df.select(
        F.col(key).cast("long").alias("row_id"),
        *[F.col(column).alias(side) for side, (column, _) in sides.items()],
    )
    schema = ", ".join(["row_id long", *[f"{side} array<{element}>" for side in sides]])
    return inputs.mapInArrow(run, schema)


class OnnxEncoder:
    """A text and an image model; tensors are addressed by name.

    The first input and first output of each model are used.
    """

    def __init__(self, text_model: bytes, image_model: bytes, threads: int = 1):
        import onnxruntime

        options = onnxruntime.SessionOptions()
        # Spark already runs one task per core.
        options.intra_op_num_threads = threads
        options.inter_op_num_threads = threads
        self._sessions = {
            name: onnxruntime.InferenceSession(
                model, options, providers=["CPUExecutionProvider"]
            )
            for name, model in (("text", text_model), ("image", image_model))
        }

    def _run(self, name: str, values: Sequence[np.ndarray]) -> np.ndarray:
        session = self._sessions[name]
        source, target = session.get_inputs()[0], session.get_outputs()[0]
        kinds = {
            "tensor(float)": np.float32, "tensor(double)": np.float64, "tensor(int64)": np.int64,
        }
        tensor = np.stack(values).astype(kinds[source.type])
        return session.run([target.name], {source.name: tensor})[0]

    def text(self, values: Sequence[np.ndarray]) -> np.ndarray:
        return self._run("text", values)

    def image(self, values: Sequence[np.ndarray]) -> np.ndarray:
        return self._run("image", values)


def onnx_factory(
    spark: SparkSession, text_model: bytes, image_model: bytes
) -> Callable[[], Encoder]:
    """Encoder factory that ships the model files once per executor."""
    shared = spark.sparkContext.broadcast((text_model, image_model))
    return lambda: OnnxEncoder(*shared.value)


def vector_report(vectors: DataFrame) -> DataFrame:
    """Row count and smallest and largest width of each vector column."""
    return vectors.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(F.size("text")).alias("text_min"),
        F.max(F.size("text")).alias("text_max"),
        F.min(F.size("img")).alias("img_min"),
        F.max(F.size("img")).alias("img_max"),
    )
