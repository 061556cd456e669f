"""CSV tables with free text: header line, quoted fields, quotes doubled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The dialect of the prepared, label and result tables.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}


def _escaped(text: Column) -> Column:
    """A text on one line: backslash, line feed and carriage return as two characters."""
    for plain, coded in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def _restored(text: Column) -> Column:
    """The text again; what stands between doubled backslashes has single ones only."""
    parts = F.split(text, r"\\\\", -1)
    plain = F.transform(
        parts,
        lambda part: F.replace(
            F.replace(part, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")
        ),
    )
    return F.array_join(plain, "\\")


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = False
) -> DataFrame:
    """A table of ``write_csv``. Every row is a line, so files are split among tasks.

    ``multi_line`` reads files of other writers, whose fields hold line breaks
    and bare backslashes; each such file is one task.
    """
    read = spark.read.options(**CSV_OPTIONS, multiLine=multi_line).schema(schema).csv(path)
    return read if multi_line else read.withColumns({c: _restored(F.col(c)) for c in _texts(read)})


def write_csv(df: DataFrame, path: str, mode: str = "error", multi_line: bool = False) -> None:
    """Write one line per row; with ``multi_line`` line breaks stay as they are."""
    rows = df if multi_line else df.withColumns({c: _escaped(F.col(c)) for c in _texts(df)})
    rows.write.options(**CSV_OPTIONS).mode(mode).csv(path)
