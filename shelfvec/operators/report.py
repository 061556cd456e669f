"""Comparison tables over results, timings and projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfvec.operators.features import FEATURE_SETS, PROJECTION_COMPONENTS, reduce_dimensions
from shelfvec.operators.joins import gather, lookup_join
from shelfvec.operators.metrics import METRICS
from shelfvec.operators.numbering import with_positions
from shelfvec.sources.scratch import materialize


def mean_by_model(
    results: DataFrame,
    by: Sequence[str] = ("model", "data_type"),
    metrics: Sequence[str] = METRICS,
) -> DataFrame:
    return results.groupBy(*by).agg(*[F.avg(name).alias(name) for name in metrics])


def percent_change(value: Column, base: Column) -> Column:
    """Null where there is no base or the base is 0."""
    return F.when(base != 0, (value - base) / base * 100)


def relative_to_baseline(
    means: DataFrame,
    baseline: str,
    model: str = "model",
    match: Sequence[str] = ("data_type",),
    metrics: Sequence[str] = METRICS,
    **join_options,
) -> DataFrame:
    """Percent change of each metric against the baseline row of the same data type.

    The means are written first, or their source would be read once for the
    baseline and again for the rest.
    """
    means = materialize(means, "means")
    base = means.where(F.col(model) == baseline).select(
        *match, *[F.col(name).alias(f"_{name}") for name in metrics]
    )
    return lookup_join(means, base, match, **join_options).select(
        model, *match, *[percent_change(F.col(m), F.col(f"_{m}")).alias(m) for m in metrics]
    )


def metric_tables(
    means: DataFrame,
    model: str = "model",
    data_type: str = "data_type",
    data_types: Sequence[str] = FEATURE_SETS,
    metrics: Sequence[str] = METRICS,
) -> dict[str, DataFrame]:
    """Per metric, models as rows and data types as columns."""
    return {
        metric: means.groupBy(model).pivot(data_type, list(data_types)).agg(F.first(metric))
        for metric in metrics
    }


def rounded(df: DataFrame, columns: Sequence[str] = METRICS, digits: int = 3) -> DataFrame:
    """Rounding of the scaled value, halves to even, as numpy does it."""
    scale = F.lit(float(10**digits))
    return df.withColumns({name: F.rint(F.col(name) * scale) / scale for name in columns})


def best_rows(
    results: DataFrame,
    position: str,
    by: Sequence[str] = ("model", "task"),
    metric: str = "f1",
    **join_options,
) -> DataFrame:
    """Row with the highest metric per group; the first position on a tie.

    The maximum and then the lowest position are plain numbers, so both
    aggregates hash and combine in the map tasks. A window, or a maximum of
    whole rows, would sort every row of a large group.
    """
    value = F.col(metric)
    known = results.where(value.isNotNull() & ~F.isnan(value.cast("double")))
    top = known.groupBy(*by).agg(F.max(metric).alias("_top"))
    tied = lookup_join(known, top, by, "inner", **join_options).where(value == F.col("_top"))
    ties = materialize(tied.drop("_top"), "ties")
    first = ties.groupBy(*by).agg(F.min(position).alias("_first"))
    chosen = lookup_join(ties, first, by, "inner", **join_options)
    best = materialize(chosen.where(F.col(position) == F.col("_first")).select(*results.columns), "best")
    if not best.groupBy(*by).count().where(F.col("count") > 1).isEmpty():
        raise ValueError(f"{position} repeats a value among the best rows of a group")
    return best


def sorted_by_metric(results: DataFrame, metric: str = "f1") -> DataFrame:
    return results.orderBy(F.desc_nulls_last(metric))


def compare_timings(
    timings: DataFrame,
    baseline: str,
    engine: str = "engine",
    stage: Sequence[str] = ("stage",),
    seconds: str = "seconds",
    **join_options,
) -> DataFrame:
    """Mean, sample deviation and percent difference from the baseline engine."""
    means = timings.groupBy(engine, *stage).agg(
        F.avg(seconds).alias("mean"), F.stddev_samp(seconds).alias("deviation")
    )
    means = materialize(means, "timings")
    base = means.where(F.col(engine) == baseline).select(*stage, F.col("mean").alias("_base"))
    return lookup_join(means, base, stage, **join_options).select(
        engine,
        *stage,
        "mean",
        "deviation",
        percent_change(F.col("mean"), F.col("_base")).alias("difference"),
    )


def quartiles(
    timings: DataFrame,
    by: Sequence[str] = ("engine", "stage"),
    value: str = "seconds",
    levels: Sequence[float] = (0.25, 0.5, 0.75),
    **join_options,
) -> DataFrame:
    """Exact minimum, interpolated quantiles and maximum per group.

    ``percentile`` would hold every distinct value of a group in one task.
    Here all values are sorted into dense positions, a group is a run of them,
    and only the two neighbours of each quantile are kept.
    """
    present = timings.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_value"))
    placed = with_positions(present, [*by, "_value"], "_place")
    extent = placed.groupBy(*by).agg(
        F.min("_place").alias("_start"),
        F.count(F.lit(1)).alias("n"),
        F.min("_value").alias("minimum"),
        F.max("_value").alias("maximum"),
    )
    joined = lookup_join(placed, extent, by, how="inner", **join_options)
    last = F.col("n") - 1
    inside = F.col("_place") - F.col("_start")
    picks = []
    for level in levels:
        exact = F.lit(float(level)) * last
        below = F.floor(exact)
        share = exact - below
        pick = F.when(inside == below, F.col("_value") * (1 - share)).when(
            inside == below + 1, F.col("_value") * share
        )
        picks.append((f"q{round(level * 100)}", F.when((share > 0) | (inside == below), pick)))
    wanted = picks[0][1].isNotNull()
    for _, pick in picks[1:]:
        wanted = wanted | pick.isNotNull()
    return joined.where(wanted).groupBy(*by).agg(
        F.first("n").alias("n"),
        F.first("minimum").alias("minimum"),
        *[F.sum(pick).alias(name) for name, pick in picks],
        F.first("maximum").alias("maximum"),
    )


def project_vectors(
    vectors: DataFrame,
    catalog: DataFrame,
    column: str = "text",
    components: int = PROJECTION_COMPONENTS,
) -> DataFrame:
    """``x, y, z, category, title`` of one vector column: its principal components."""
    source = vectors.select("row_id", array_to_vector(column).alias("_vector"))
    points = reduce_dimensions(source, "_vector", "_point", components)
    axes = vector_to_array("_point")
    placed = points.select(
        "row_id", *[axes[i].alias(name) for i, name in enumerate("xyz"[:components])]
    )
    # Every vector needs its one catalog row, by the rule that holds for labels and vectors.
    named = catalog.select("row_id", "category", "title")
    return gather(placed, named).select(*placed.columns, "category", "title")

