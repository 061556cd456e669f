"""A training-corpus pipeline over ``documents``: five stages, each stored and reread.

Every stage works on all that the one before it kept. All but the last return
the columns of ``documents``; the last one adds the token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfvec.llm import contamination, fertility, lines, pieces, simhash
from shelfvec.sources.scratch import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return fertility.keep_good(docs)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on many sites; ``n_chars`` follows the text.

    Only those that consist of such lines alone keep them.
    """
    kept = lines.drop_spread_lines(docs, max_share=None)
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash fingerprints: three-word shingles, two bits."""
    return simhash.keep_one_of_component(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination.without_leaks(docs, items)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents with their token ids, which are decoded and compared with the text.

    An id list that does not decode to its text, but for the tokenizer's own
    space sign, which comes back as a space, stops the run.
    """
    back = next(n for n in ("decoded", *(f"decoded_{i}" for i in range(len(docs.columns)))) if n not in docs.columns)
    coded = pieces.encode_pieces(docs, decoded_col=back)
    want = F.translate(F.coalesce("text", F.lit("")), pieces.SPACE, " ")
    tokens = F.when(F.col(back) == want, F.col("tokens")).otherwise(F.raise_error("token ids do not decode to their text"))
    return coded.withColumn("tokens", tokens).drop(back)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("lines", without_boilerplate),
    ("near-copies", one_of_copies),
    ("contamination", decontaminated),
    ("tokens", encoded),
]

#: The stages use fingerprints, search and a tokenizer that SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
