"""Dense row positions, shuffles, heads and fixed-size batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfvec.functions.ordering import copy_spread, hashable, shuffle_key
from shelfvec.functions.text import as_column
from shelfvec.sources.scratch import materialize

# monotonically_increasing_id keeps the partition above bit 33.
_PARTITION_BITS = 33


def with_positions(
    df: DataFrame, order_by: Sequence[Column | str], name: str = "row_id", unique: bool = False
) -> DataFrame:
    """Number rows 0..n-1 in the given order without a one-task window.

    ``unique`` says that no two rows are equal in ``order_by``; then no other
    column is read to tell rows apart.

    Rows are range-partitioned and sorted once, then written with their
    partition and place in it, because a second run could sample other range
    bounds. A position is the place plus the sizes of the earlier partitions.
    That small table has one row per partition, so its window and broadcast
    are bounded by the partition count, not by the data.
    """
    keys = [as_column(key) for key in order_by]
    ties = {} if unique else dict(zip(("_tie_part", "_tie_hash"), copy_spread(hashable(df))))
    tied = df.withColumns(ties)
    ranged = tied.repartitionByRange(*keys, *ties).sortWithinPartitions(*keys, *ties)
    stamped = materialize(
        ranged.drop(*ties).withColumn("_slot", F.monotonically_increasing_id()), "positions"
    )
    part = F.shiftrightunsigned("_slot", _PARTITION_BITS)
    place = F.col("_slot").bitwiseAND(F.lit((1 << _PARTITION_BITS) - 1))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stamped.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    return (
        stamped.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + place)
        .drop("_part", "_offset", "_slot")
    )


def renumber(
    df: DataFrame, order_by: Sequence[Column | str], name: str = "row_id"
) -> DataFrame:
    """Fresh positions after a filter, the former ones kept as ``old_index``."""
    if name in df.columns:
        df = df.withColumnRenamed(name, "old_index")
    return with_positions(df, order_by, name)


def shuffled(df: DataFrame, key: str, seed: int = 42, name: str = "row_id") -> DataFrame:
    """Rows numbered in a reproducible random order."""
    return with_positions(df, [shuffle_key(key, seed), key], name)


def batch_of(size: int, position: Column | str = "row_id") -> Column:
    """Batch number of a position; batches hold ``size`` consecutive rows."""
    return F.floor(as_column(position) / F.lit(size)).cast("long")


def head(df: DataFrame, order_by: Sequence[Column | str], n: int) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def random_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in the reproducible random order."""
    return df.orderBy(shuffle_key(key, seed), key).limit(n)
