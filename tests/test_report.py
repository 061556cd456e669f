from __future__ import annotations

import numpy as np
import pytest

from shelfvec.operators import report as R
from shelfvec.plans.reporting import baseline_tables, leaderboard
from shelfvec.schemas import RESULTS


@pytest.fixture(scope="module")
def results(spark):
    rows = [
        ("base", "a", "Text", 0.5, 0.0, 0.4),
        ("base", "b", "Text", 0.7, 0.0, 0.6),
        ("base", "a", "Image", 0.2, 0.2, 0.2),
        ("tuned", "a", "Text", 0.9, 0.3, 0.5),
        ("tuned", "a", "Image", 0.1, 0.3, 0.3),
        ("tuned", "a", "Extra", 0.1, 0.3, 0.3),
    ]
    return spark.createDataFrame(rows, RESULTS)


def test_relative_to_baseline(results):
    means = R.mean_by_model(results)
    got = {(r.model, r.data_type): r for r in R.relative_to_baseline(means, "base").collect()}
    assert got["base", "Text"].f1 == 0
    assert got["tuned", "Text"].f1 == pytest.approx(50)
    assert got["tuned", "Text"].precision is None  # base is 0
    assert got["tuned", "Extra"].f1 is None  # no base row


def test_tables_per_metric(results):
    tables = baseline_tables(results, "base", ["Text", "Image"])
    f1 = {r.model: (r.Text, r.Image) for r in tables["f1"].collect()}
    assert f1 == {"base": (0.0, 0.0), "tuned": (50.0, -50.0)}


def test_rounding_equals_numpy(spark):
    values = [0.0005, 0.0015, 1.0005, 2.6755, -0.0025, 8.1125, 1 / 3]
    df = spark.createDataFrame([(v,) for v in values], "f1 double")
    got = [r.f1 for r in R.rounded(df, ["f1"]).collect()]
    assert got == np.round(values, 3).tolist()


def test_best_rows_first_wins_ties_and_unknown_is_skipped(spark):
    rows = [
        (0, "m", "t", float("nan")), (1, "m", "t", 0.5), (2, "m", "t", 0.5), (3, "m", "t", None),
        (4, "n", "t", 0.9), (5, "n", "t", 0.1),
    ]
    df = spark.createDataFrame(rows, "pos int, model string, task string, f1 double")
    assert sorted(r.pos for r in R.best_rows(df, "pos").collect()) == [1, 4]
    board = leaderboard(df, "pos").collect()
    assert [r.pos for r in board] == [4, 1]
    assert [r.pos for r in leaderboard(df, "pos", ["m"]).collect()] == [1]


def test_best_rows_needs_no_sort(spark, results, plan_of, tmp_path):
    results.selectExpr("*", "row_number() OVER (ORDER BY task) AS pos").write.parquet(str(tmp_path / "r"))
    plan = plan_of(R.best_rows(spark.read.parquet(str(tmp_path / "r")), "pos"))
    assert "Window" not in plan and "Sort" not in plan


def test_timing_comparison(spark):
    rows = [("a", "s", 1.0), ("a", "s", 3.0), ("b", "s", 3.0), ("b", "s", 5.0), ("b", "only", 1.0)]
    df = spark.createDataFrame(rows, "engine string, stage string, seconds double")
    got = {(r.engine, r.stage): r for r in R.compare_timings(df, "a").collect()}
    assert got["b", "s"].mean == 4 and got["b", "s"].difference == 100
    assert got["b", "s"].deviation == pytest.approx(2**0.5)
    assert got["b", "only"].difference is None and got["b", "only"].deviation is None


@pytest.mark.parametrize("limit", [10**9, -1])
def test_quartiles_equal_numpy(spark, limit):
    rng = np.random.default_rng(6)
    groups = {"a": rng.normal(size=101), "b": np.array([2.0]), "c": np.full(40, 7.5), "d": rng.normal(size=12)}
    rows = [(g, "s", float(v)) for g, values in groups.items() for v in values]
    rows.append(("a", "s", None))
    df = spark.createDataFrame(rows, "engine string, stage string, seconds double").repartition(5)
    got = {r.engine: r for r in R.quartiles(df, limit_bytes=limit).collect()}
    for name, values in groups.items():
        want = np.quantile(values, [0.25, 0.5, 0.75])
        r = got[name]
        np.testing.assert_allclose([r.q25, r.q50, r.q75], want)
        assert (r.n, r.minimum, r.maximum) == (len(values), values.min(), values.max())


def test_best_rows_refuse_a_repeated_position(spark):
    rows = [("m", "t", 1, 0.5), ("m", "t", 1, 0.5), ("m", "u", 1, 0.5)]
    df = spark.createDataFrame(rows, "model string, task string, pos int, f1 double")
    with pytest.raises(ValueError, match="repeats"):
        R.best_rows(df, "pos")


def test_projection_needs_every_catalog_row(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0, float(i * i)]) for i in range(6)], "row_id long, text array<float>")
    catalog = vectors.selectExpr("row_id", "'c' AS category", "'t' AS title")
    with pytest.raises(ValueError, match="outside"):
        R.project_vectors(vectors, catalog.where("row_id < 4"))
    with pytest.raises(ValueError, match="several"):
        R.project_vectors(vectors, catalog.union(catalog))


def test_projection_is_a_rotation(spark):
    rng = np.random.default_rng(7)
    data = rng.normal(size=(30, 3))
    vectors = spark.createDataFrame(
        [(i, row.tolist()) for i, row in enumerate(data)], "row_id long, text array<float>"
    )
    catalog = vectors.selectExpr("row_id", "'c' AS category", "CAST(row_id AS string) AS title")
    got = R.project_vectors(vectors, catalog).orderBy("row_id").collect()
    assert [r.title for r in got] == [str(i) for i in range(30)]
    points = np.array([(r.x, r.y, r.z) for r in got])
    scaled = (data - data.mean(0)) / data.std(0)
    np.testing.assert_allclose((points**2).sum(1), (scaled**2).sum(1), rtol=1e-4)
