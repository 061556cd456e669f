"""Use of all cores on inputs with few file splits."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when a file scan has fewer splits than there are cores.

    A file with one row group is read by one task, and costly text expressions
    would then run on one core. A large table has many more splits than cores
    and is returned as it is, without a shuffle. For frames read straight from
    files only: counting the splits of others would run their shuffles.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
