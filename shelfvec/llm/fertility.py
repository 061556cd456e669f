"""Quality rules from how a public tokeniser splits a text.

Three figures per document: characters per token, the share of byte-fallback
tokens (line breaks aside) and the entropy of its token ids in bits. Prose of a
language keeps close to the language's own values; shouting, symbol noise and
foreign bytes split into too many tokens, and endless repeats have too few
distinct ones. The bands are multiples of the values of all texts of the same
language, or of the same script where the language is null.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfvec.llm import pieces
from shelfvec.llm.words import words_of
from shelfvec.sources.scratch import materialize
from shelfvec.sources.shipping import ensure_shipped


@dataclass(frozen=True)
class Bands:
    """Rejection bounds, as multiples of the language's values but for ``byte_share``."""

    min_chars_per_token: float = 0.88
    max_chars_per_token: float = 1.5
    byte_share: float = 0.1
    min_entropy: float = 0.75
    min_words: int = 50
    max_repeat_percent: int = 50


FIGURES = {
    "n_words": T.LongType(),
    "word_chars": T.LongType(),
    "n_symbols": T.LongType(),
    "n_dup_lines": T.LongType(),
    "n_repeat_words": T.LongType(),
    "n_tokens": T.LongType(),
    "n_chars_seen": T.LongType(),
    "n_byte_tokens": T.LongType(),
    "token_entropy": T.DoubleType(),
    "band_group": T.StringType(),
}
VERDICTS = ["chars_per_token", "byte_share", "base_failed", "kept"]

#: First code points of blocks and the script each begins, for texts without a language.
SCRIPTS = ((0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "semitic"), (0x900, "indic"), (0xE00, "other"), (0x3040, "cjk"), (0xD7B0, "other"))


def script_of(text: str) -> str:
    """The script of most letters; ``none`` without letters."""
    votes: dict[str, int] = {}
    for char in text:
        if char.isalpha():
            point = ord(char)
            name = next((n for first, n in reversed(SCRIPTS) if point >= first), "latin")
            votes[name] = votes.get(name, 0) + 1
    return max(sorted(votes), key=votes.get) if votes else "none"


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of three words found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered = bytearray(len(words))
    for at, window in enumerate(windows):
        if times[window] > 1:
            covered[at : at + 3] = b"\1\1\1"
    return sum(covered)


def token_entropy(ids: np.ndarray) -> float:
    """Entropy of a text's token ids in bits."""
    if not len(ids):
        return 0.0
    # Narrow numbers are sorted by radix.
    ordered = np.sort(ids.astype("u2") if ids.max() < 1 << 16 else ids, kind="stable")
    ends = np.append(np.flatnonzero(ordered[1:] != ordered[:-1]), len(ids) - 1)
    share = np.diff(ends, prepend=-1) / len(ids)
    return float(-(share * np.log2(share)).sum()) + 0.0


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


class Figures:
    def __init__(self, model_file: str):
        self.codec = pieces.codec(model_file)
        self.fallback = np.zeros(self.codec.library.get_piece_size(), dtype=bool)
        self.fallback[[i for b, i in self.codec.bytes.items() if b != 10]] = True

    def of(self, text: str | None, lang: str | None) -> tuple:
        text = text or ""
        words = words_of(text)
        ids = np.frombuffer(self.codec.encode(text), "<i4")
        return (
            len(words),
            sum(map(len, words)),
            sum(text.count(c) for c in "#*$%&|<>"),
            duplicate_lines(text),
            repeated_words(words),
            len(ids),
            len(text),
            int(self.fallback[ids].sum()),
            token_entropy(ids),
            lang if lang is not None else f"script {script_of(text)}",
        )


def token_figures(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    model_file: str | None = None,
    drop_text: bool = False,
) -> DataFrame:
    """The columns in FIGURES for every whole text, one row per document, no shuffle."""
    path = model_file or pieces.model_path()
    ensure_shipped(docs.sparkSession)
    gone = {*FIGURES, *VERDICTS, *([text_col] if drop_text else [])}
    rest = [f for f in docs.schema.fields if f.name not in gone]
    kept = [f.name for f in rest]
    schema = T.StructType([*rest, *(T.StructField(n, t) for n, t in FIGURES.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        figures = Figures(path)
        for batch in batches:
            texts, langs = batch.column(text_col).to_pylist(), batch.column(lang_col).to_pylist()
            rows = [figures.of(t, x) for t, x in zip(texts, langs, strict=True)]
            new = zip(*rows, strict=True) if rows else [()] * len(FIGURES)
            kinds = [pa.int64()] * 8 + [pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in kept]
                + [pa.array(c, k) for c, k in zip(new, kinds, strict=True)],
                names=[*kept, *FIGURES],
            )

    return docs.mapInArrow(run, schema)


def quality_rules(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    bands: Bands | None = None,
    model_file: str | None = None,
    drop_text: bool = False,
) -> DataFrame:
    """Documents with their figures, ``base_failed`` and ``kept``; no row is dropped.

    ``base_failed``: under ``min_words`` words, or more than ``max_repeat_percent``
    of them in repeated three-word windows. Any other text is kept if its
    figures lie in the bands. The languages' values are sums over all texts that
    did not fail: characters over tokens, and mean entropy.

    A null or empty text has no words and fails. Repeated rows count as often as
    they stand. Columns named like the new ones are replaced. An empty table
    gives an empty table. The figures are stored once, so texts are split once.
    """
    rule = bands or Bands()
    failed = (F.col("n_words") < rule.min_words) | (
        100 * F.col("n_repeat_words") > rule.max_repeat_percent * F.col("n_words")
    )
    figures = materialize(
        token_figures(docs, text_col, lang_col, model_file, drop_text).withColumn("base_failed", failed),
        "fertility",
    )
    usual = (
        figures.where(~F.col("base_failed"))
        .groupBy("band_group")
        .agg(
            (F.sum("n_chars_seen") / F.sum("n_tokens")).alias("_usual_chars"),
            F.round(F.avg("token_entropy"), 6).alias("_usual_entropy"),
        )
    )
    # A row per language: stored, so that the join sees how small it is and moves no text.
    usual = materialize(usual, "bands").select(F.struct("band_group", "_usual_chars", "_usual_entropy").alias("usual"))
    # The row rides in a struct, so that no column of it can clash with those of the bands.
    own = {c: F.col("row")[c] for c in figures.columns}
    joined = figures.select(F.struct(*figures.columns).alias("row")).join(usual, own["band_group"] == F.col("usual.band_group"), "left")
    tokens = F.greatest(own["n_tokens"], F.lit(1))
    per_token, byte_share = own["n_chars_seen"] / tokens, own["n_byte_tokens"] / tokens
    in_bands = (
        (per_token / F.col("usual._usual_chars")).between(rule.min_chars_per_token, rule.max_chars_per_token)
        & (byte_share <= rule.byte_share)
        & (own["token_entropy"] >= rule.min_entropy * F.col("usual._usual_entropy"))
    )
    return joined.select(
        *[value.alias(c) for c, value in own.items()],
        per_token.alias("chars_per_token"),
        byte_share.alias("byte_share"),
        (~own["base_failed"] & F.coalesce(in_bands, F.lit(False))).alias("kept"),
    )


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """The registered query: every document's figures and verdict, as ``quality_rules`` defines them.

    Null and empty texts fail, repeated rows and equal ids are treated row by
    row, an empty table gives an empty table.
    """
    return quality_rules(docs.select("doc_id", "text", "lang"), drop_text=True).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_tokens",
        "chars_per_token",
        "byte_share",
        "token_entropy",
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents the rules keep, with their own columns only."""
    extra = [c for c in docs.columns if c in {*FIGURES, *VERDICTS}]
    if extra:  # the caller's columns of these names come back untouched
        docs = docs.withColumnsRenamed({c: f"_own_{c}" for c in extra})
    kept = quality_rules(docs).where("kept").select(*docs.columns)
    return kept.withColumnsRenamed({f"_own_{c}": c for c in extra})
