"""The row-local part of the catalog flow over files as they arrive.

Preparation and encoding touch one row at a time, so the batch operators run
unchanged on a stream and need no state or watermark. Row positions,
labels and evaluation need the whole table and stay batch jobs; the
product id is the key here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfvec.operators.encode import Encoder, encode
from shelfvec.plans.preparation import prepare_catalog
from shelfvec.schemas import PRODUCT


def arriving_products(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    return (
        spark.readStream.schema(PRODUCT)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def prepare_arriving(products: DataFrame, image_dir: str) -> DataFrame:
    return prepare_catalog(products, image_dir)


def encode_arriving(
    rows: DataFrame, factory: Callable[[], Encoder], text: str, image: str, model: str
) -> DataFrame:
    """``model, nm, text, img`` for a file sink."""
    vectors = encode(rows, factory, text=text, image=image, key="nm")
    return vectors.withColumnRenamed("row_id", "nm").withColumn("model", F.lit(model))
