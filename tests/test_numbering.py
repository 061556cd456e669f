from __future__ import annotations

import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfvec.functions.ordering import shuffle_key
from shelfvec.operators import numbering as N
from shelfvec.sources import scratch


def test_dense_and_ordered_over_partitions(spark):
    values = list(range(1000))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "nm long").repartition(7)
    rows = N.with_positions(df, ["nm"]).collect()
    assert sorted((r.row_id, r.nm) for r in rows) == [(i, i) for i in range(1000)]


def test_descending_and_composite_order(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 1), ("b", 9)], "k string, v int")
    rows = N.with_positions(df, ["k", F.col("v").desc()]).orderBy("row_id").collect()
    assert [(r.k, r.v) for r in rows] == [("a", 2), ("a", 1), ("b", 9), ("b", 1)]


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "nm long")
    assert N.with_positions(empty, ["nm"]).count() == 0
    assert N.with_positions(spark.range(1).toDF("nm"), ["nm"]).first().row_id == 0


def test_empty_input_partitions(spark):
    df = spark.range(3).toDF("nm").repartition(8, "nm")
    assert sorted(r.row_id for r in N.with_positions(df, ["nm"]).collect()) == [0, 1, 2]


def test_copies_of_one_row_are_split(spark):
    """A third and more of all rows are the same row; no task may get them all."""
    df = spark.range(9000).select(
        F.when(F.col("id") < 6000, F.lit(5)).otherwise(F.col("id")).alias("nm")
    ).repartition(8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        seen = {}
        original = N.materialize

        def spy(frame, label="stage", partition_by=()):
            stored = original(frame, label, partition_by)
            seen["stored"] = stored
            return stored

        N.materialize = spy
        rows = N.with_positions(df, ["nm"]).collect()
    finally:
        N.materialize = original
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(r.row_id for r in rows) == list(range(9000))
    ordered = [r.nm for r in sorted(rows, key=lambda r: r.row_id)]
    assert ordered == sorted(ordered)
    part = F.shiftrightunsigned("_slot", 33)
    largest = seen["stored"].groupBy(part).count().agg(F.max("count")).first()[0]
    assert largest < 3000


def test_renumber_keeps_old_position(spark):
    numbered = N.with_positions(spark.range(10).toDF("nm"), ["nm"])
    again = N.renumber(numbered.where("nm % 2 = 1"), ["nm"]).orderBy("nm").collect()
    assert [(r.old_index, r.row_id) for r in again] == [(1, 0), (3, 1), (5, 2), (7, 3), (9, 4)]


def test_no_single_task_window_over_rows(spark, plan_of):
    plan = plan_of(N.with_positions(spark.range(100).toDF("nm"), ["nm"]))
    # The only window runs over one row per partition.
    assert plan.count("Window [") == 1 and "BroadcastHashJoin" in plan


def test_shuffle_is_reproducible_and_complete(spark):
    df = spark.range(500).toDF("nm")
    first = {r.nm: r.row_id for r in N.shuffled(df.repartition(3), "nm").collect()}
    second = {r.nm: r.row_id for r in N.shuffled(df.repartition(11), "nm").collect()}
    assert first == second and sorted(first.values()) == list(range(500))
    assert [first[i] for i in range(500)] != list(range(500))
    other = {r.nm: r.row_id for r in N.shuffled(df, "nm", seed=7).collect()}
    assert other != first


def test_shuffle_key_is_the_md5_prefix(spark):
    import hashlib

    got = spark.range(3).select("id", shuffle_key("id", 42).alias("k")).collect()
    for row in got:
        assert row.k == int(hashlib.md5(f"42|{row.id}".encode()).hexdigest()[:15], 16)


def test_heads_and_batches(spark):
    df = spark.range(25).toDF("row_id")
    assert [r.row_id for r in N.head(df, ["row_id"], 3).collect()] == [0, 1, 2]
    assert len({r.row_id for r in N.random_rows(df, "row_id", 10).collect()}) == 10
    sizes = df.groupBy(N.batch_of(10).alias("b")).count().orderBy("b").collect()
    assert [r["count"] for r in sizes] == [10, 10, 5]


def test_scratch_needs_a_shared_folder_on_clusters(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_root(Session())


def test_map_columns_and_unique_keys(spark, plan_of):
    df = spark.range(50).selectExpr("49 - id AS k", "map('a', id) AS m").repartition(4)
    for unique in (False, True):
        got = N.with_positions(df, ["k"], unique=unique)
        assert sorted((r.row_id, r.k, r.m["a"]) for r in got.collect()) == [(i, i, 49 - i) for i in range(50)]


def test_scratch_on_a_session_without_the_setting(tmp_path):
    """In a process of its own, as the setting is the session's."""
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from pyspark.sql import SparkSession\n"
        "from shelfvec.sources.scratch import drop_scratch, materialize, scratch_root\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "assert spark.conf.get('spark.checkpoint.dir', None) in (None, ''), 'set by default here'\n"
        "assert materialize(spark.range(3)).count() == 3\n"
        "assert scratch_root(spark) == scratch_root(spark)\n"
        "import os; folder = f'{scratch_root(spark)}/shelfvec/{spark.sparkContext.applicationId}'\n"
        "assert os.listdir(folder); drop_scratch(spark); assert not os.path.exists(folder)\n"
    )
    conf = tmp_path / "conf"
    conf.mkdir()
    root = str(Path(__file__).resolve().parents[1])
    env = {**os.environ, "SPARK_CONF_DIR": str(conf)}
    done = subprocess.run([sys.executable, "-c", code, root], env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
