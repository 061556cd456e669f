"""Joins, unions and set differences keyed by row position or by a lookup."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfvec.functions.ordering import copy_spread
from shelfvec.sources.scratch import materialize

# A lookup is broadcast only while its measured size stays below this.
BROADCAST_BYTES = 32 * 1024 * 1024
# Beyond that, keys of more rows than this are cut into this many slices.
HOT_ROWS = 1_000_000
SALTS = 64


def measured_bytes(df: DataFrame) -> int:
    """Approximate in-memory size, from one aggregate over the table."""
    width = F.lit(16)
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType):
            width = width + 8 * F.greatest(F.size(field.name), F.lit(0))
        else:
            width = width + F.lit(8)
    return df.agg(F.sum(width.cast("long"))).first()[0] or 0


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    limit_bytes: int = BROADCAST_BYTES,
    hot_rows: int = HOT_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``rows`` to a ``lookup`` with one row per key.

    The lookup is written and measured. A small one is broadcast, so ``rows``
    is not shuffled and hot keys cost nothing. A larger one is joined by
    shuffle on key and salt. Keys of more than ``hot_rows`` rows get ``salts``
    slices and as many copies of their lookup row; all others have one slice.
    There are at most ``count / hot_rows`` hot keys, which bounds what is
    broadcast to mark them.
    """
    if how not in ("left", "inner"):
        raise ValueError("lookup_join supports left and inner joins")
    lookup = materialize(lookup, "lookup")
    keys = list(keys)
    if measured_bytes(lookup) <= limit_bytes:
        return rows.join(F.broadcast(lookup), keys, how)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = materialize(
        counts.where(F.col("_n") > hot_rows).select(*keys, F.lit(True).alias("_hot")), "hot"
    )
    part, content = copy_spread(rows.columns)
    # Null keys match nothing and would otherwise all meet in one task.
    loose = F.col("_hot") | reduce(Column.__or__, [F.col(key).isNull() for key in keys])
    slice_of_row = F.when(loose, F.pmod(content + part, F.lit(salts)).cast("int"))
    slices = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
    salted_rows = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.coalesce(slice_of_row, F.lit(0))
    )
    salted_lookup = lookup.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.explode(F.coalesce(slices, F.array(F.lit(0))))
    )
    joined = salted_rows.drop("_hot").join(salted_lookup.drop("_hot"), [*keys, "_salt"], how)
    return joined.drop("_salt")


def _required(matched: Column, message: str) -> Column:
    return F.when(matched, F.lit(True)).otherwise(
        F.raise_error(F.lit(message)).cast("boolean")
    )


def gather(
    labels: DataFrame,
    vectors: DataFrame,
    key: str = "row_id",
    limit_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Vectors at the labelled positions; a repeated label repeats its vector.

    Stops at once if a label has no vector, also one without a position, or if a
    labelled position has several. That is checked on the key columns before
    the join, by the same counts for any size. Labels of measured small size
    are broadcast, so the vectors, far wider, are not shuffled. Otherwise both
    sides are shuffled; should one position hold a large share of the labels,
    the adaptive skew join splits it, as there is one vector per position.
    """
    labels = materialize(labels, "labels")
    small = measured_bytes(labels) <= limit_bytes
    keys = labels.select(key).distinct()
    found = vectors.select(key).join(F.broadcast(keys) if small else keys, key, "left_semi")
    seen = found.groupBy(key).count().agg(F.count("*").alias("n"), F.max("count").alias("most")).first()
    if (seen["most"] or 0) > 1:
        raise ValueError("a position has several vectors")
    if seen["n"] < keys.count():
        raise ValueError("label position outside the vector table")
    columns = [*labels.columns, *[name for name in vectors.columns if name != key]]
    joined = vectors.join(F.broadcast(labels), key) if small else labels.join(vectors, key)
    return joined.select(*columns)


def require_unique(df: DataFrame, key: str, what: str) -> None:
    """Stop if a key occurs twice; counts combine in the map tasks."""
    if not df.groupBy(key).count().where(F.col("count") > 1).isEmpty():
        raise ValueError(f"{what} repeats a value of {key}")


def align(left: DataFrame, right: DataFrame, key: str = "row_id") -> DataFrame:
    """Pair two whole tables by position; any unmatched side stops the query.

    A position that either side repeats stops it before the join.
    """
    require_unique(left, key, "the left table")
    require_unique(right, key, "the right table")
    a = left.withColumn("_left", F.lit(True))
    b = right.withColumn("_right", F.lit(True))
    both = F.col("_left").isNotNull() & F.col("_right").isNotNull()
    return (
        a.join(b, key, "full_outer")
        .where(_required(both, "tables differ in their row positions"))
        .drop("_left", "_right")
    )


def run_grid(spark: SparkSession, models: Sequence[str], tasks: Sequence[str]) -> DataFrame:
    """Every model with every task, from two lists held by the caller."""
    return spark.createDataFrame(
        [(model, task) for model in models for task in tasks], "model string, task string"
    )


def append(*tables: DataFrame) -> DataFrame:
    """Row union by column name; repeats are kept."""
    return reduce(DataFrame.unionByName, tables)


def difference(rows: DataFrame, other: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows whose key is absent from ``other``."""
    return rows.join(other.select(key).distinct(), key, "left_anti")
