"""Declared schemas of the tables that cross a file boundary."""

from __future__ import annotations

from pyspark.sql import types as T

PRODUCT = T.StructType(
    [
        T.StructField("nm", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("sub_category", T.StringType()),
        T.StructField("isadult", T.BooleanType()),
        T.StructField("brend", T.StringType()),
    ]
)

# Present in some product files only.
PRODUCT_OPTIONAL = {
    "price": T.DoubleType(),
    "characteristics": T.BinaryType(),
}

PREPARED = T.StructType(
    [
        T.StructField("nm", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("image_path", T.StringType()),
    ]
)

LABELS = T.StructType(
    [T.StructField("row_id", T.LongType()), T.StructField("target", T.IntegerType())]
)

VECTORS = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("row_id", T.LongType()),
        T.StructField("text", T.ArrayType(T.FloatType())),
        T.StructField("img", T.ArrayType(T.FloatType())),
    ]
)

LEMMAS = T.StructType(
    [
        T.StructField("lang", T.StringType()),
        T.StructField("form", T.StringType()),
        T.StructField("lemma", T.StringType()),
    ]
)

RESULTS = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("f1", T.DoubleType()),
        T.StructField("precision", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
    ]
)

TIMINGS = T.StructType(
    [
        T.StructField("engine", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("rep", T.IntegerType()),
        T.StructField("seconds", T.DoubleType()),
    ]
)
