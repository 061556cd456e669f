"""Image files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that a list of images may lie in; more are refused, not read in part.
MAX_FOLDERS = 100_000
IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def _load(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.format("image").option("dropInvalid", False).load(paths)


def _number(origin: Column) -> Column:
    """Leading number of a file's name; null for any other name."""
    name = F.element_at(F.split(origin, "/"), -1)
    return F.split(name, r"\.")[0].try_cast("long")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded files as ``nm, image``; undecodable files have sizes of -1.

    ``nm`` is the leading number of the file name; files without one are left out.
    """
    images = _load(spark, path)
    return images.select(_number(F.col("image.origin")).alias("nm"), "image").where(
        F.col("nm").isNotNull()
    )


def read_listed_images(listed: DataFrame, path_col: str = "image_path") -> DataFrame:
    """``nm, image`` of the files that a table lists, a row for each path found.

    The folders of the listed paths are read, others are not. Keep large sets in
    many folders, so that no listing is one flat folder of all files. Paths are
    compared without their scheme. Listing a path twice reads it once.
    """
    spark = listed.sparkSession
    bare = lambda path: F.regexp_replace(path, r"^[a-zA-Z][a-zA-Z0-9+.-]*:/+", "/")
    wanted = listed.where(F.col(path_col).isNotNull()).select(F.col(path_col).alias("_path")).distinct()
    # A folder spelled with and without its scheme is one folder.
    folder = F.regexp_replace("_path", "/[^/]*$", "")
    folders = wanted.select(folder.alias("folder")).groupBy(bare(F.col("folder"))).agg(F.min("folder").alias("folder"))
    found = [r["folder"] for r in folders.limit(MAX_FOLDERS + 1).collect()]
    if len(found) > MAX_FOLDERS:
        raise ValueError(f"images lie in more than {MAX_FOLDERS} folders")
    if not found:
        return spark.createDataFrame([], f"nm long, image {IMAGE}")
    images = _load(spark, sorted(found)).withColumn("_path", bare(F.col("image.origin")))
    paths = wanted.select(bare(F.col("_path")).alias("_path")).distinct()
    return images.join(paths, "_path", "left_semi").select(
        _number(F.col("image.origin")).alias("nm"), "image"
    )
