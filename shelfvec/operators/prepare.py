"""Filters and projections on the product table. All are row-local."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfvec.functions.text import as_column, fill_blank

# Known-bad product id, image suffix, optional columns.
BAD_IDS = (87996913,)
IMAGE_SUFFIX = ".jpg"
UNUSED_COLUMNS = ("price",)
REQUIRED_TEXT = ("title", "description", "characteristics")


def drop_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull())


def fill_blanks(df: DataFrame, columns: Sequence[str] = ("title", "description")) -> DataFrame:
    return df.withColumns({name: fill_blank(name) for name in columns})


def drop_ids(df: DataFrame, key: str = "nm", ids: Sequence[int] = BAD_IDS) -> DataFrame:
    return df.where(~F.col(key).isin(*ids))


def id_from_file_name(name: Column | str) -> Column:
    """Leading number of names such as ``123.jpg``."""
    return F.split(as_column(name), r"\.")[0].cast("long")


def drop_listed(
    df: DataFrame, names: DataFrame, key: str = "nm", name_column: str = "monochrome_img"
) -> DataFrame:
    """Drop rows whose id occurs in a table of image file names.

    No hint is given: the list is small when it comes from a file and Catalyst
    sees its size; a long list is shuffled once, after removing repeats.
    """
    listed = names.select(id_from_file_name(name_column).alias(key)).distinct()
    return df.join(listed, key, "left_anti")


def drop_incomplete(df: DataFrame, columns: Sequence[str] = REQUIRED_TEXT) -> DataFrame:
    """Drop rows with a null in any of ``columns`` that the table has."""
    return df.dropna(subset=[name for name in columns if name in df.columns])


def drop_columns(df: DataFrame, columns: Sequence[str] = UNUSED_COLUMNS) -> DataFrame:
    return df.drop(*columns)


def drop_unnamed_index(df: DataFrame) -> DataFrame:
    """Drop the index column that saved result tables carry."""
    return df.drop("Unnamed: 0", "_c0")


def decode_bytes(df: DataFrame, column: str = "characteristics") -> DataFrame:
    """Read a binary column as UTF-8; other columns and types are left alone."""
    if column not in df.columns or df.schema[column].dataType != T.BinaryType():
        return df
    return df.withColumn(column, F.decode(column, "UTF-8"))


def image_path(base: str, key: Column | str = "nm", separator: str = "/") -> Column:
    return F.concat(
        F.lit(base), F.lit(separator), as_column(key).cast("string"), F.lit(IMAGE_SUFFIX)
    )


def rewrite_paths(df: DataFrame, old: str, new: str, column: str = "image_path") -> DataFrame:
    """Replace a literal path prefix."""
    return df.withColumn(column, F.replace(F.col(column), F.lit(old), F.lit(new)))


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")
    return df


def require_same_length(first: Sequence, second: Sequence, what: str) -> None:
    if len(first) != len(second):
        raise ValueError(f"{what}: {len(first)} and {len(second)} entries given")


def is_finite_vector(vector: Column | str, element: T.DataType = T.FloatType()) -> Column:
    """False when any component is NaN or infinite.

    ``element`` is the component type. Membership tests are compiled; a lambda
    over the components would be interpreted.
    """
    vector = as_column(vector)
    found = [
        F.coalesce(F.array_contains(vector, F.lit(float(odd)).cast(element)), F.lit(False))
        for odd in ("nan", "inf", "-inf")
    ]
    return ~(found[0] | found[1] | found[2])


def keep_finite(df: DataFrame, columns: Sequence[str], on_bad: str = "raise") -> DataFrame:
    """Stop at, or with ``on_bad="drop"`` leave out, rows with NaN or infinity."""
    good = F.lit(True)
    for name in columns:
        good = good & is_finite_vector(name, df.schema[name].dataType.elementType)
    if on_bad == "drop":
        return df.where(good)
    message = F.lit(f"NaN or infinity in {', '.join(columns)}")
    return df.where(F.when(good, True).otherwise(F.raise_error(message).cast("boolean")))


def bool_to_int(value: Column | str) -> Column:
    """True and false as 1 and 0; a null stops the query."""
    value = as_column(value)
    return F.when(value.isNull(), F.raise_error(F.lit("null flag")).cast("int")).otherwise(
        value.cast("int")
    )


def keep_members(df: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    return df.where(F.col(column).isin(*values))
