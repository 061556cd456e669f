"""Product tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfvec.schemas import PRODUCT, PRODUCT_OPTIONAL


def read_products(
    spark: SparkSession, *paths: str, optional: Sequence[str] = ()
) -> DataFrame:
    """Parquet product files under the declared schema.

    ``optional`` names the extra columns a file set carries.
    """
    extra = [T.StructField(name, PRODUCT_OPTIONAL[name]) for name in optional]
    return spark.read.schema(T.StructType([*PRODUCT.fields, *extra])).parquet(*paths)


def read_splits(spark: SparkSession, paths: dict[str, str], schema: T.StructType) -> DataFrame:
    """Several Parquet tables of one schema with their split names, as one table."""
    parts = [
        spark.read.schema(schema).parquet(path).withColumn("split", F.lit(split))
        for split, path in paths.items()
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
