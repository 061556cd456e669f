"""Groups of near-equal vectors against all pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from shelfvec.operators import identical as I
from shelfvec.operators.identical import identical_products, similar_pairs, table_count


def brute(ids, x, threshold):
    norms = np.linalg.norm(x, axis=1)
    u = np.divide(x, norms[:, None], out=np.zeros_like(x), where=norms[:, None] > 0)
    close = u @ u.T >= threshold
    np.fill_diagonal(close, False)
    label = np.array(ids)
    while True:
        new = np.array([min([label[i], *label[close[i]]]) for i in range(len(ids))])
        if (new == label).all():
            return {i: (int(r), int(c.sum())) for i, r, c in zip(ids, label, close, strict=True)}
        label = new


def products(seed=1, groups=40, width=16):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        base = rng.normal(size=width)
        for _ in range(int(rng.integers(1, 6))):
            rows.append(base + rng.normal(size=width) * rng.choice([0.0, 0.05, 0.2]))
    hot = rng.normal(size=width)
    rows += [hot * rng.uniform(0.5, 2) + rng.normal(size=width) * 0.03 for _ in range(60)]
    rows += [hot.copy() for _ in range(30)]
    x = np.array(rows)
    return rng.permutation(len(x)) + 5, x


@pytest.mark.parametrize("chunk", [1024, 7])
def test_groups_equal_all_pairs(spark, chunk):
    ids, x = products()
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)] + [(1000, [0.0] * 16), (1001, [0.0] * 16), (1002, None)]
    df = spark.createDataFrame(rows, "row_id long, vector array<double>").repartition(5)
    out = identical_products(df, 0.95, chunk=chunk, recall=0.99999)
    got = {r.row_id: (r.product_id, r.n_links) for r in out.collect()}
    want = brute([int(i) for i in ids], x, 0.95)
    want.update({1000: (1000, 0), 1001: (1001, 0), 1002: (1002, 0)})
    assert got == want


def test_recall_at_the_threshold(spark):
    """Pairs right at the threshold are the hardest; the stated chance holds for them."""
    rng = np.random.default_rng(3)
    threshold, n = 0.9, 600
    a = rng.normal(size=(n, 24))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=(n, 24))
    b -= (b * a).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    near = 0.9001 * a + np.sqrt(1 - 0.9001**2) * b
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, near]))]
    units = spark.createDataFrame(rows, "node long, unit array<double>")
    tables = table_count(threshold, 10, 0.95)
    pairs = {tuple(r) for r in similar_pairs(units, 24, threshold, 10, tables, 1024, 42).collect()}
    assert len([i for i in range(n) if (i, i + n) in pairs]) / n >= 0.92
    x = np.concatenate([a, near])
    assert all(x[u] @ x[v] >= threshold - 1e-12 and u < v for u, v in pairs)


def test_empty_table_and_other_names(spark):
    df = spark.createDataFrame([], "sku long, v array<float>")
    assert identical_products(df, key="sku", column="v").collect() == []
    one = spark.createDataFrame([(3, [1.0, 0.0]), (4, [2.0, 0.0])], "sku long, v array<float>")
    out = identical_products(one, key="sku", column="v").collect()
    assert {(r.row_id, r.product_id, r.n_links) for r in out} == {(3, 3, 1), (4, 3, 1)}


def test_bucket_rows_come_in_pieces_of_bounded_size():
    """Forty copies of a batch are never held at once."""
    rng = np.random.default_rng(6)
    x, planes = rng.normal(size=(5000, 64)), rng.normal(size=(64, 40 * 12))
    unit = pa.ListArray.from_arrays(pa.array(np.arange(5001, dtype="i4") * 64), pa.array(x.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(5000)), unit], names=["node", "unit"])
    pieces = list(I.bucket_rows(batch, planes, 12, ["node", "unit", "bucket"]))
    assert max(p.nbytes for p in pieces) <= I.PIECE_BYTES and sum(p.num_rows for p in pieces) == 200_000
    found = np.concatenate([p.column("bucket").to_numpy() for p in pieces]).reshape(5000, 40)
    want = ((x @ planes > 0).reshape(5000, 40, 12) @ (1 << np.arange(12))) + (np.arange(40) << 12)
    assert (found == want).all()
    assert (np.concatenate([p.column("node").to_numpy() for p in pieces]).reshape(5000, 40) == np.arange(5000)[:, None]).all()
