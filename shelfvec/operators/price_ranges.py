"""Classes of equal size from a numeric column, with exact bounds at any size.

A mergeable quantile sketch of the whole column brackets every bound; the rows
below a bracket and inside it are counted; a bracket that still holds many rows
is sketched again. A bracket shrinks some thousandfold each time, so a few
passes leave so few rows that their values can be counted one by one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accuracy of a sketch (its rank error is one over it) and rows that are counted value by value.
ACCURACY = 10_000
EXACT_ROWS = 100_000


@dataclass
class Bracket:
    """The value of a rank lies from ``low`` to ``high``; ``below`` rows are less than ``low``."""

    rank: int
    low: float
    high: float
    below: int
    inside: int
    margin: float

    def holds(self, value: Column) -> Column:
        return (value >= self.low) & (value <= self.high)


def exact_bounds(df: DataFrame, column: str, shares: Sequence[float], accuracy: int = ACCURACY, exact_rows: int = EXACT_ROWS) -> list[float]:
    """For each share q the value of rank ceil(q * n), the least being rank 1.

    Nulls and NaN have no rank; an empty column has no bounds. At most
    ``exact_rows`` counted values per share reach the driver.
    """
    value = F.col("x")
    rows = df.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    whole = rows.agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    if not whole["n"]:
        return []
    n = whole["n"]
    ranks = [min(max(math.ceil(q * n - 1e-9), 1), n) for q in shares]
    brackets = [Bracket(r, whole["low"], whole["high"], 0, n, 2 / accuracy) for r in ranks]
    while wide := [b for b in brackets if b.inside > exact_rows and b.low < b.high]:
        sketches = []
        for i, b in enumerate(wide):
            at = (b.rank - b.below) / b.inside
            probes = [F.lit(min(max(p, 0.0), 1.0)) for p in (at - b.margin, at, at + b.margin)]
            sketches.append(F.percentile_approx(F.when(b.holds(value), value), F.array(*probes), accuracy).alias(f"s{i}"))
        found = rows.agg(*sketches).first()
        probes = [found[f"s{i}"] for i in range(len(wide))]
        counts = []
        for i, (low, middle, high) in enumerate(probes):
            held = {"low": value < low, "in": (value >= low) & (value <= high), "less": value < middle, "same": value == middle}
            counts += [F.count(F.when(test, 1)).alias(f"{name}{i}") for name, test in held.items()]
        counted = rows.agg(*counts).first()
        for i, (b, (low, middle, high)) in enumerate(zip(wide, probes, strict=True)):
            below, inside, less, same = (counted[f"{name}{i}"] for name in ("low", "in", "less", "same"))
            if less < b.rank <= less + same:
                b.low, b.high, b.below, b.inside = middle, middle, less, same
            elif below < b.rank <= below + inside and inside < b.inside:
                b.low, b.high, b.below, b.inside = low, high, below, inside
            # A sketch that missed, or gained nothing: one of its values is no answer at least.
            elif b.rank <= less:
                b.high, b.inside = math.nextafter(middle, -math.inf), less - b.below
            else:
                b.low, b.inside, b.below = math.nextafter(middle, math.inf), b.below + b.inside - less - same, less + same
    return [_value_of(rows, b) for b in brackets]


def _value_of(rows: DataFrame, b: Bracket) -> float:
    if b.low == b.high:
        return b.low
    values = rows.where(b.holds(F.col("x"))).groupBy("x").agg(F.count("*").alias("n")).orderBy("x").collect()
    seen = b.below
    for row in values:
        seen += row["n"]
        if seen >= b.rank:
            return row["x"]
    raise ValueError("the bracket lost its rank")


def price_classes(df: DataFrame, column: str, classes: int, output: str = "target", **options) -> DataFrame:
    """Add the class 0 to ``classes - 1`` of each value, from the exact bounds of equal shares.

    A value equal to a bound belongs to the lower class, so equal values share a
    class. Null and NaN have none.
    """
    if classes < 1:
        raise ValueError("at least one class")
    bounds = exact_bounds(df, column, [k / classes for k in range(1, classes)], **options)
    value = F.col(column).cast("double")
    above = [F.when(value > b, 1).otherwise(0) for b in bounds]
    number = sum(above, F.lit(0))
    return df.withColumn(output, F.when(value.isNotNull() & ~F.isnan(value), number).cast("int"))
