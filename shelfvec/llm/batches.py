"""Batches of documents, and questions that batches ask of hash buckets.

A corpus-wide statistic about small things, such as how often a word occurs or
whether a text fragment occurs elsewhere, is too large to be sent to all tasks
and too fine to be a table row each. Documents are packed into batches of
bounded size. Each batch asks every bucket of hashes about its own distinct
keys, packed into one binary; the bucket answers all batches; the answers go
back to the batch. Hot keys are in a bucket once per batch, however often they
stand in the corpus. The number of buckets follows the data, so that a bucket
stays small.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfvec.sources.scratch import materialize
from shelfvec.sources.shipping import ensure_shipped

#: Text bytes of a batch; a longer document is a batch by itself.
BATCH_BYTES = 8 << 20
#: Text bytes whose questions a bucket answers, about.
BUCKET_BYTES = 32 << 20

#: Instead of a bucket: what a batch notes for its own later passes.
NOTES = -1

PACKED = T.StructType(
    [
        T.StructField("batch", T.LongType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("load", T.BinaryType(), False),
    ]
)
ASKED = T.StructType(
    [
        T.StructField("batch", T.LongType(), False),
        T.StructField("bucket", T.IntegerType(), False),
        T.StructField("question", T.BinaryType(), False),
    ]
)
ANSWERED = T.StructType(
    [
        T.StructField("batch", T.LongType(), False),
        T.StructField("bucket", T.IntegerType(), False),
        T.StructField("answer", T.BinaryType(), False),
        T.StructField("found", T.BinaryType()),
    ]
)


def pack(value: object, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(pickle.dumps(value, protocol=5))


def unpack(data: bytes) -> object:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def pack_documents(
    docs: DataFrame,
    batch_bytes: int = BATCH_BYTES,
    level: int = 3,
    prepare: Callable[[list[bytes]], object] | None = None,
) -> DataFrame:
    """``doc_id, text`` as batches, stored in the shared folder.

    With ``prepare``, what it makes of a batch's texts is stored in their place.

    A batch holds whole documents in the order of the input's partitions and is
    compressed. Stored once, its content never changes, so questions and
    answers match however often a task runs.
    """
    ensure_shipped(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def packed() -> pa.RecordBatch:
            held = prepare(texts) if prepare else texts
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([size]), pa.array([pack((ids, held), level)], pa.binary())],
                names=PACKED.names,
            )

        for batch in batches:
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
            for doc_id, text in rows:
                data = (text or "").encode()
                if size and size + len(data) > batch_bytes:
                    yield packed()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(doc_id)
                texts.append(data)
                size += len(data) + 16
        if ids:
            yield packed()

    return materialize(docs.select("doc_id", "text").mapInArrow(run, PACKED), "batches")


def bucket_count(batches: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for a table of batches; as many as shuffles have partitions at least."""
    size = batches.agg(F.sum("size").alias("n")).first()["n"] or 0
    least = int(batches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, size // bucket_bytes + 1)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each 64-bit key, from its high half."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype("i4")


def ask(
    batches: DataFrame, questions: Callable[[list, list[bytes], dict], Iterator[tuple[int, object]]]
) -> DataFrame:
    """``batch, bucket, question`` rows, for the buckets that a batch has keys in.

    A question under ``NOTES`` goes to a group of its own batch, or few batches.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, texts, answers in _opened(parts):
            own = NOTES - (batch + (batch >> 32) * 7919) % (1 << 30)
            asked = [
                (own if b == NOTES else b, pack(q)) for b, q in questions(ids, texts, answers)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch] * len(asked), pa.int64()),
                    pa.array([b for b, _ in asked], pa.int32()),
                    pa.array([q for _, q in asked], pa.binary()),
                ],
                names=ASKED.names,
            )

    return batches.mapInArrow(run, ASKED)


def _opened(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes], dict]]:
    """One batch of documents at a time, with its answers by bucket if it has any."""
    for part in parts:
        for row in range(part.num_rows):
            ids, texts = unpack(part.column("load")[row].as_py())
            answers = {}
            if "answers" in part.schema.names:
                for x in part.column("answers")[row].as_py() or []:
                    answers[max(x["bucket"], NOTES)] = unpack(x["answer"])
            yield part.column("batch")[row].as_py(), ids, texts, answers


def answer(
    asked: DataFrame,
    buckets: int,
    respond: Callable[[list[object]], tuple[list[object], object]],
    label: str,
) -> DataFrame:
    """Answers of each bucket to its questions, in the order of their batches; stored.

    ``respond`` also returns what the bucket found out about its keys as a
    whole, which stands as ``found`` in one row of the bucket.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("batch")
        replies, found = respond([unpack(q) for q in rows["question"]])
        return pd.DataFrame(
            {
                "batch": rows["batch"].to_numpy(),
                "bucket": rows["bucket"].to_numpy(),
                "answer": [pack(r) for r in replies],
                "found": [pack(found)] + [None] * (len(rows) - 1),
            }
        )

    grouped = asked.repartition(buckets, "bucket").groupBy("bucket")
    return materialize(grouped.applyInPandas(run, ANSWERED), label)


def findings(
    answered: DataFrame, schema: T.StructType, rows_of: Callable[[object], list[pa.Array]]
) -> DataFrame:
    """Rows made from what each bucket found."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for data in part.column("found").to_pylist():
                yield pa.RecordBatch.from_arrays(rows_of(unpack(data)), names=schema.names)

    return answered.select("found").where(F.col("found").isNotNull()).mapInArrow(run, schema)


def with_answers(batches: DataFrame, answered: DataFrame) -> DataFrame:
    """Batches with their answers, one per bucket asked."""
    mine = answered.groupBy("batch").agg(F.collect_list(F.struct("bucket", "answer")).alias("answers"))
    return batches.join(mine, "batch", "left")


def map_documents(
    batches: DataFrame,
    schema: T.StructType,
    rows_of: Callable[[list, list[bytes], dict[int, object]], list[pa.Array]],
) -> DataFrame:
    """Rows made from each batch and its answers; ``rows_of`` returns the columns."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, texts, answers in _opened(parts):
            yield pa.RecordBatch.from_arrays(rows_of(ids, texts, answers), names=schema.names)

    return batches.mapInArrow(run, schema)
