from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfvec.operators import prepare as P
from shelfvec.plans.preparation import (
    number_catalog,
    prepare_catalog,
    prepare_training,
    prepared_columns,
)
from shelfvec.schemas import PRODUCT
from shelfvec.sources.products import read_products, read_splits
from shelfvec.sources.tables import read_csv, write_csv


def product(nm, title, description, category="c", isadult=False):
    return (nm, title, description, category, "s", isadult, "b")


@pytest.fixture(scope="module")
def products(spark):
    rows = [
        product(1, None, "good"),
        product(2, "", "good"),
        product(3, "\t\n", "good"),
        product(4, "\u00a0", "good"),
        product(5, "\x1c", " "),
        product(6, "title", None),
        product(7, "title", "text"),
        product(87996913, "title", "text"),
    ]
    return spark.createDataFrame(rows, PRODUCT)


def test_catalog_rules_in_order(products):
    rows = prepare_catalog(products, "/img").orderBy("nm").collect()
    assert [(r.nm, r.title, r.description) for r in rows] == [
        (2, "No info", "good"),
        (3, "No info", "good"),
        (4, "No info", "good"),
        (5, "No info", "No info"),
        (7, "title", "text"),
    ]
    assert rows[0].image_path == "/img/2.jpg"


def test_known_bad_id_can_be_kept(products):
    assert prepare_catalog(products, "/img", bad_ids=()).where("nm > 10").count() == 1


def test_backslash_paths_and_positions(products):
    rows = number_catalog(prepared_columns(prepare_catalog(products, "D:\\x", "\\"))).collect()
    assert sorted((r.row_id, r.image_path) for r in rows)[:2] == [
        (0, "D:\\x\\2.jpg"),
        (1, "D:\\x\\3.jpg"),
    ]


def test_training_variant(spark):
    rows = [(12, "a", "b", 1.5, "цвет".encode()), (13, "a", "b", 2.0, None), (14, "a", "b", 1.0, b"x")]
    df = spark.createDataFrame(
        rows, "nm long, title string, description string, price double, characteristics binary"
    )
    names = spark.createDataFrame([("14.png",), ("14.jpg",), ("999.jpg",)], "monochrome_img string")
    out = prepare_training(df, "/img", names)
    assert "price" not in out.columns
    assert [(r.nm, r.characteristics) for r in out.collect()] == [(12, "цвет")]
    without = prepare_training(df.drop("characteristics", "price"), "/img")
    assert without.count() == 3


def test_rewrite_is_literal(spark):
    df = spark.createDataFrame([("C:\\a.b\\1.jpg",), ("C:\\aXb\\1.jpg",)], "image_path string")
    got = [r[0] for r in P.rewrite_paths(df, "C:\\a.b\\", "/new/").collect()]
    assert got == ["/new/1.jpg", "C:\\aXb\\1.jpg"]


def test_checks_raise(spark):
    df = spark.createDataFrame([(1, None)], "index long, flag boolean")
    with pytest.raises(ValueError, match="target"):
        P.require_columns(df, "target")
    with pytest.raises(ValueError):
        P.require_same_length([1], [1, 2], "inputs and outputs")
    with pytest.raises(Exception, match="null flag"):
        df.select(P.bool_to_int("flag").alias("flag")).collect()


def test_finite_vectors(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame(
        [(1, [1.0, nan]), (2, [inf, 0.0]), (3, [1.0, 2.0]), (4, [-inf, 0.0])], "id int, v array<float>"
    )
    assert [r.id for r in P.keep_finite(df, ["v"], on_bad="drop").collect()] == [3]
    with pytest.raises(Exception, match="NaN or infinity"):
        P.keep_finite(df, ["v"]).select("id").collect()
    assert P.keep_finite(df.where("id = 3"), ["v"]).count() == 1


def test_csv_keeps_free_text(spark, tmp_path):
    rows = [(1, 'a "quoted", text\nwith lines'), (2, "tab\tand \\ back"), (3, "plain"), (4, "\\n \\\\r\r\n\\")]
    df = spark.createDataFrame(rows, "nm long, title string")
    write_csv(df, str(tmp_path / "t"))
    back = read_csv(spark, str(tmp_path / "t"), df.schema)
    assert sorted(tuple(r) for r in back.collect()) == rows
    write_csv(df, str(tmp_path / "m"), multi_line=True)
    other = read_csv(spark, str(tmp_path / "m"), df.schema, multi_line=True)
    assert sorted(r.nm for r in other.collect()) == [1, 2, 3, 4]
    labels = spark.range(5).selectExpr("id AS row_id", "CAST(id % 2 AS int) AS target")
    write_csv(labels, str(tmp_path / "l"))
    again = read_csv(spark, str(tmp_path / "l"), labels.schema, multi_line=False)
    assert sorted(tuple(r) for r in again.collect()) == [(i, i % 2) for i in range(5)]


def test_product_reader_pushes_filters_and_prunes(spark, products, tmp_path, plan_of):
    path = str(tmp_path / "p")
    products.write.parquet(path)
    read = read_products(spark, path)
    assert read.schema == PRODUCT
    plan = plan_of(prepared_columns(prepare_catalog(read, "/img")))
    assert "IsNotNull(title)" in plan and "IsNotNull(description)" in plan
    assert "Not(EqualTo(nm,87996913))" in plan
    assert "category" not in plan and "Exchange" not in plan


def test_optional_columns_and_splits(spark, products, tmp_path):
    extra = products.withColumn("price", F.lit(2.5))
    for name in ("train", "test"):
        extra.write.parquet(str(tmp_path / name))
    read = read_products(spark, str(tmp_path / "train"), str(tmp_path / "test"), optional=["price"])
    assert read.count() == 16 and read.agg(F.sum("price")).first()[0] == 40.0
    paths = {name: str(tmp_path / name) for name in ("train", "test")}
    both = read_splits(spark, paths, PRODUCT)
    assert {r["split"]: r["count"] for r in both.groupBy("split").count().collect()} == {
        "train": 8,
        "test": 8,
    }
