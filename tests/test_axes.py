"""Axes of wide vectors against numpy's."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array

from shelfvec.operators import axes as A


def frame(spark, data):
    rows = [(i, x.tolist()) for i, x in enumerate(data)]
    return spark.createDataFrame(rows, "row_id long, v array<double>").select("row_id", array_to_vector("v").alias("v"))


def wanted(data, k):
    deviation = data.std(0)
    scaled = np.divide(data - data.mean(0), deviation, out=np.zeros_like(data), where=deviation > 0)
    _, values, axes = np.linalg.svd(scaled, full_matrices=False)
    return scaled @ axes[:k].T, (values**2 / len(data))[:k]


def got(df, name):
    return np.array([r.x for r in df.select("row_id", vector_to_array(name).alias("x")).orderBy("row_id").collect()])


def test_narrow_vectors_and_constant_components(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(90, 8)) @ rng.normal(size=(8, 8)) + 5
    data[:, 3] = 2.0
    want, _ = wanted(data, 4)
    out = got(A.reduce_wide(frame(spark, data).repartition(4), "v", "p", 4, turn=1e-12), "p")
    np.testing.assert_allclose(np.abs(out), np.abs(want), atol=1e-6)
    assert got(A.reduce_wide(frame(spark, data), "v", "p", 99), "p").shape == (90, 8)


def test_four_thousand_components(spark):
    """Numbers on the driver stay at width by directions: far from a width-squared matrix."""
    rng = np.random.default_rng(2)
    factors = rng.normal(size=(120, 5)) * [9, 7, 5, 4, 3]
    data = factors @ rng.normal(size=(5, 4096)) + rng.normal(size=(120, 4096))
    want, values = wanted(data, 3)
    df = frame(spark, data).repartition(3)
    rows = df.select(vector_to_array("v").alias("x"))
    _, _, axes, found = A.leading_axes(rows, 3, extra=5, turn=1e-10)
    assert axes.shape == (4096, 3)
    np.testing.assert_allclose(found, values, rtol=1e-8)
    out = got(A.reduce_wide(df, "v", "p", 3, extra=5, turn=1e-10), "p")
    np.testing.assert_allclose(np.abs(out), np.abs(want), atol=1e-4)


def test_partial_sums_of_many_partitions_and_no_rows(spark):
    data = np.random.default_rng(3).normal(size=(70, 4))
    rows = frame(spark, data).select(vector_to_array("v").alias("x"))
    few, A.DIRECT_PARTS = A.DIRECT_PARTS, 2
    try:
        n, mean, deviation = A.moments(rows.repartition(9))
    finally:
        A.DIRECT_PARTS = few
    assert n == 70
    np.testing.assert_allclose(mean, data.mean(0))
    np.testing.assert_allclose(deviation, data.std(0))
    assert A.reduce_wide(frame(spark, data).where("row_id < 0"), "v", "p", 2).collect() == []


def test_close_variances_take_few_rounds_over_the_rows(spark, monkeypatch):
    """Variances that hardly differ: a single block would turn for hundreds of rounds."""
    data = np.random.default_rng(4).normal(size=(400, 60))
    want, values = wanted(data, 3)
    passes = []
    sums = A._sums
    monkeypatch.setattr(A, "_sums", lambda *args: passes.append(1) or sums(*args))
    rows = frame(spark, data).select(vector_to_array("v").alias("x")).coalesce(2).cache()
    _, _, axes, found = A.leading_axes(rows, 3, turn=1e-11)
    np.testing.assert_allclose(found, values, rtol=1e-10)
    deviation = (data - data.mean(0)) / data.std(0)
    np.testing.assert_allclose(np.abs(deviation @ axes), np.abs(want), atol=1e-8)
    assert len(passes) <= 2 + 4
    # Blocks that are given up for the best of them lose nothing.
    monkeypatch.setattr(A, "KEPT_BLOCKS", 2)
    _, _, axes, found = A.leading_axes(rows, 3, extra=4, turn=1e-10)
    np.testing.assert_allclose(found, values, rtol=1e-10)
    np.testing.assert_allclose(np.abs(deviation @ axes), np.abs(want), atol=1e-6)
