"""From result tables to the comparison tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from shelfvec.operators.features import FEATURE_SETS
from shelfvec.operators.metrics import METRICS
from shelfvec.operators.prepare import drop_unnamed_index, keep_members
from shelfvec.operators.report import (
    best_rows,
    mean_by_model,
    metric_tables,
    relative_to_baseline,
    rounded,
    sorted_by_metric,
)


def baseline_tables(
    results: DataFrame, baseline: str, data_types: Sequence[str] = FEATURE_SETS
) -> dict[str, DataFrame]:
    """Per metric, the rounded percent change of every model against ``baseline``."""
    change = relative_to_baseline(mean_by_model(results), baseline)
    return metric_tables(rounded(change), data_types=data_types, metrics=METRICS)


def leaderboard(results: DataFrame, position: str, models: Sequence[str] = ()) -> DataFrame:
    """Best feature set per model and task, highest F1 first."""
    # The saved index column may be the position, so it goes last.
    best = drop_unnamed_index(best_rows(results, position))
    return sorted_by_metric(keep_members(best, "model", models) if models else best)
