"""Reproducible pseudo-random order keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfvec.functions.text import as_column


def shuffle_key(key: Column | str, seed: int = 42) -> Column:
    """60 pseudo-random bits per key, the same in every run and on every engine.

    A seeded generator would depend on how rows fall into partitions; a digest
    of the key does not, so a lost task computes the same value again.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}|"), as_column(key).cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def copy_spread(columns: list[str]) -> list[Column]:
    """Tie-breakers that split even a large group of identical rows.

    Content alone cannot tell copies apart. The input partition can, and it
    stays the same when a task is run again, whatever order its rows arrive in.
    """
    return [F.spark_partition_id(), F.xxhash64(*columns) if columns else F.lit(0)]


def hashable(df: DataFrame) -> list[str]:
    """Columns that have a hash: all but those with a map in them."""
    return [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
