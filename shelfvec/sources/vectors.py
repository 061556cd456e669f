"""Vector store: one Parquet table for all models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfvec.schemas import VECTORS


def write_vectors(df: DataFrame, path: str, mode: str = "append") -> None:
    """Store ``model, row_id, text, img`` with one directory per model.

    Files keep the row ranges of the writing partitions, so a store written
    from numbered rows is clustered by ``row_id``.
    """
    df.select(*VECTORS.fieldNames()).write.partitionBy("model").mode(mode).parquet(path)


def write_bucketed(
    df: DataFrame, table: str, buckets: int, path: str | None = None, mode: str = "append"
) -> None:
    """Store vectors as a catalog table bucketed by ``row_id``.

    Every model is joined to every label table by position. From buckets the
    vectors, the wide side, are joined without a shuffle each time; only the
    labels move. Choose ``buckets`` so that one bucket of one model fits a task.
    """
    # Rows meet by bucket first, or each task would write a file per bucket.
    placed = df.select(*VECTORS.fieldNames()).repartition(buckets, "row_id")
    writer = placed.write.partitionBy("model").mode(mode)
    if path:
        writer = writer.option("path", path)
    writer.bucketBy(buckets, "row_id").sortBy("row_id").saveAsTable(table)


def read_vectors(spark: SparkSession, path: str, models: Sequence[str] = ()) -> DataFrame:
    """Vectors of the named models; other models' directories are not read."""
    store = spark.read.schema(VECTORS).parquet(path)
    return store.where(F.col("model").isin(*models)) if models else store


def read_bucketed(spark: SparkSession, table: str, models: Sequence[str] = ()) -> DataFrame:
    store = spark.table(table)
    return store.where(F.col("model").isin(*models)) if models else store
