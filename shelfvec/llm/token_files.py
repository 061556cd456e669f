"""Token ids of documents as Parquet files that can be read in parts.

Files lie in ascending ``doc_id`` order, one range of ids each, and hold a row
per document: ``part, doc_id, local_start, n_tokens, tokens``. ``tokens`` is a
list column in dictionary encoding; the integer columns are delta encoded. Row
groups and pages are small enough, and sorted, so that the page index leads a
reader of a few documents to a few pages, and readers of metadata never touch
the tokens. ``start`` of a document in the whole sequence is its start in the
file plus the sizes of earlier files; no pass over all rows in one task.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfvec.llm.arrow_rows import list_column, texts_of
from shelfvec.sources.scratch import fresh_path, materialize
from shelfvec.sources.shipping import ensure_shipped

#: Words kept in a worker's memo, and the longest word worth keeping.
MEMO_WORDS, MEMO_CHARS = 400_000, 64

FILE_SCHEMA = T.StructType(
    [
        T.StructField("part", T.IntegerType(), False),
        T.StructField("doc_id", T.LongType()),
        T.StructField("local_start", T.LongType(), False),
        T.StructField("n_tokens", T.LongType(), False),
        T.StructField("tokens", T.ArrayType(T.IntegerType(), False), False),
    ]
)

#: Latin-1 bytes as one of three kinds: lower-case letter, full stop or comma, other.
KINDS = bytes(
    ord("a") if chr(b).isalpha() and chr(b).islower() else ord(".") if chr(b) in ".," else ord(" ")
    for b in range(256)
)

_loaded: dict[str, WordEncoder] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(tokenizer_file: str) -> WordEncoder:
    if tokenizer_file not in _loaded:
        _loaded[tokenizer_file] = WordEncoder(tokenizer_file)
    return _loaded[tokenizer_file]


class WordEncoder:
    """Ids of whole texts under a tokenizer that drops white space.

    Text between white space is encoded by itself, once for each distinct word,
    by the tokenizers library. In texts of Latin-1 characters case does not
    matter, and a full stop or comma after a letter is a run of its own; so the
    variants of a word share the library's call.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_file)
        probe = "Ab, cd.\n\tEF;"
        pieces = [self.ids(w) for w in ("ab", ",", "cd", ".", "ef", ";")]
        if sum(pieces, []) != self.ids(probe):
            raise ValueError(f"{tokenizer_file} keeps case, white space or words together")
        # Words of a-z pass the normaliser and the splitter unchanged, so the model alone knows their ids.
        self.model = self.library.model
        self.plain = all(self._model_ids(w) == self.ids(w) for w in ("a", "z", "plain", "words", "qxzjk", "etaoin" * 9))
        self.memo: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _model_ids(self, word: str) -> list[int]:
        return [token.id for token in self.model.tokenize(word)]

    def ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _keep(self, word: str, ids: bytes) -> None:
        """Into the memo; once it is full, words not met again since go first."""
        if len(word) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_WORDS:
                self.older, self.memo = self.memo, {"": b""}
            self.memo[word] = ids

    def word(self, word: str) -> bytes:
        found = self.memo.get(word)
        if found is None:
            found = self.older.get(word)
            if found is None:
                bare = self.plain and word.isascii() and word.isalpha() and word.islower()
                found = array("i", self._model_ids(word) if bare else self.ids(word)).tobytes()
            self._keep(word, found)
        return found

    def encode(self, text: str | None) -> bytes:
        """All ids as little-endian 32-bit integers; a null text is empty."""
        if not text:
            return b""
        if "<|" not in text:
            text = _variants_joined(text)
        # Only characters that are white space to every library; others stay in the words.
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        memo = self.memo
        return b"".join([memo.get(w) or self.word(w) for w in words])


def _variants_joined(text: str) -> str:
    """A Latin-1 text in lower case, its full stops and commas set off where that changes no id."""
    low = text.lower()
    try:
        kinds = low.encode("latin-1").translate(KINDS)
    except UnicodeEncodeError:
        return text
    if kinds.startswith(b".") or b" ." in kinds or b".." in kinds:
        return low
    return low.replace(".", " .").replace(",", " ,")


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_file: str | None = None,
    end_id: int = 2,
    row_group_bytes: int = 32 << 20,
    page_rows: int = 2_000,
) -> None:
    """Encode ``doc_id, text`` and write the files, in ascending ``doc_id`` order.

    Every text is encoded whole and closed with ``end_id``; a null or empty text
    has that id alone. A null ``doc_id`` sorts first; rows with equal ids stay
    apart, in the order of their texts' digests. Other columns are not read. An
    empty table gives files without rows.

    Texts are range-partitioned before they are encoded, so that sampling for
    the ranges encodes nothing.
    """
    tokenizer = tokenizer_file or tokenizer_path()
    ensure_shipped(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<i4").tobytes()
        for batch in batches:
            ids = [np.frombuffer(words.encode(t) + end, "<i4") for t in texts_of(batch, "text")]
            sizes = np.array([len(i) for i in ids], dtype="int64")
            starts = before + np.concatenate([[0], np.cumsum(sizes)])
            before = int(starts[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(ids), part, dtype="int32")),
                    batch.column("doc_id"),
                    pa.array(starts[:-1].astype("int64")),
                    pa.array(sizes),
                    list_column(ids, pa.int32()),
                ],
                names=FILE_SCHEMA.names,
            )

    digest = F.xxhash64("text")
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange("doc_id", digest)
        .sortWithinPartitions("doc_id", digest)
    )
    (
        rows.mapInArrow(run, FILE_SCHEMA)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.dictionary.page.size", 1 << 20)
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#local_start", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .parquet(path)
    )


def file_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def part_starts(rows: DataFrame) -> DataFrame:
    """Ids before each file's first one; a row for each file, from metadata columns only.

    Stored, so that its size is known and a join need not shuffle the tokens for it.
    """
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    return materialize(starts, "part-starts")


def read_tokens(
    spark: SparkSession, path: str, first: int | None = None, last: int | None = None
) -> DataFrame:
    """``doc_id, start, n_tokens, tokens`` of the documents, or of a range of ids.

    A range is pushed to the scan, where row groups and pages outside are skipped.
    Leave ``tokens`` out of the selection to read metadata alone.
    """
    rows = file_rows(spark, path)
    starts = part_starts(rows)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    return rows.join(starts, "part").select(
        "doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "tokens"
    )


def token_digests(docs: DataFrame, tokenizer_file: str | None = None) -> DataFrame:
    """Write the files in the shared folder, read them back and digest each document's ids."""
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write_token_files(docs, path, tokenizer_file)
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("start", T.LongType(), False),
            T.StructField("n_tokens", T.LongType(), False),
            T.StructField("ids_crc32", T.LongType(), False),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            at = lists.offsets.to_numpy()
            data = memoryview(ids).cast("B")
            crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("start"),
                    pa.array(np.diff(at).astype("int64")),
                    pa.array(crcs, pa.int64()),
                ],
                names=schema.names,
            )

    return read_tokens(spark, path).select("doc_id", "start", "tokens").mapInArrow(run, schema)
