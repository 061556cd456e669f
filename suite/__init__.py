"""Registered queries over the given tables, each with its SQL twin where SQL can say it.

Modules register a Spark function and, if there is one, the SQL text under the
same name. Names start with the inventory id of the operator they show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfvec.sources.spread import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are costly to process, on all cores."""
    return spread(table(spark, sf_dir, name))


def load() -> None:
    from suite import (  # noqa: F401
        catalog,
        embedding,
        evaluation,
        labelling,
        reporting,
        texts,
    )
