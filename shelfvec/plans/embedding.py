"""From the numbered catalog and image files to the vector store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfvec.operators.encode import Encoder, encode_one
from shelfvec.operators.joins import require_unique
from shelfvec.operators.resize import IMAGE_SIZE, complete_images, resize_images
from shelfvec.sources.scratch import materialize
from shelfvec.sources.vectors import write_vectors


def with_pictures(
    catalog: DataFrame, images: DataFrame, size: tuple[int, int] = IMAGE_SIZE, exact: bool = False
) -> DataFrame:
    """Add a ``picture`` per row. Images shrink before they are joined."""
    completed = complete_images(catalog, resize_images(images, size, exact), size)
    picture = F.struct("height", "width", "data").alias("picture")
    return completed.select(*catalog.columns, picture, "missing")


def embed_rows(
    catalog: DataFrame,
    images: DataFrame,
    factory: Callable[[], Encoder],
    batch_size: int = 10,
    size: tuple[int, int] = IMAGE_SIZE,
    title: str = "title",
    element: str = "float",
) -> DataFrame:
    """``row_id, text, img`` for every catalog row; only vectors are joined.

    A picture is encoded in the task that decoded and shrank it, a title where
    the catalog lies. The black picture of rows without one is encoded once.
    Stops if two pictures have one number.
    """
    spark = catalog.sparkSession
    resized = resize_images(images, size)
    picture = F.struct("height", "width", "data").alias("picture")
    coded = encode_one(resized.select("nm", picture), factory, "img", "picture", "nm", batch_size, element)
    coded = materialize(coded.withColumnRenamed("row_id", "nm"), "image-vectors")
    require_unique(coded, "nm", "the table of pictures")
    width, height = size
    black = spark.range(1).select(
        F.col("id").alias("nm"),
        F.struct(
            F.lit(height).alias("height"),
            F.lit(width).alias("width"),
            F.unhex(F.repeat(F.lit("00"), 3 * width * height)).alias("data"),
        ).alias("picture"),
    )
    blank = encode_one(black, factory, "img", "picture", "nm", batch_size, element).first()["img"]
    blank = F.array(*[F.lit(float(x)) for x in blank]).cast(f"array<{element}>")
    texts = encode_one(catalog, factory, "text", title, "row_id", batch_size, element)
    numbers = catalog.select(F.col("row_id").cast("long").alias("row_id"), "nm")
    found = numbers.join(coded, "nm", "left").select("row_id", F.coalesce("img", blank).alias("img"))
    return texts.join(found, "row_id")


def embed_catalog(
    catalog: DataFrame,
    images: DataFrame,
    factory: Callable[[], Encoder],
    model: str,
    batch_size: int = 10,
    size: tuple[int, int] = IMAGE_SIZE,
) -> DataFrame:
    """``model, row_id, text, img`` for every catalog row; row numbers are unique."""
    require_unique(catalog, "row_id", "the catalog")
    return embed_rows(catalog, images, factory, batch_size, size).withColumn("model", F.lit(model))


def store_embeddings(vectors: DataFrame, path: str) -> None:
    write_vectors(vectors, path)
