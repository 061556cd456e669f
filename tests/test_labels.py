from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from shelfvec.functions.ordering import copy_spread
from shelfvec.functions.text import clean_text, words
from shelfvec.operators import joins as J
from shelfvec.operators import labels as L


@pytest.fixture(scope="module")
def lemmas(spark):
    rows = [
        ("ru", "мужские", "мужской"),
        ("ru", "женскую", "женский"),
        ("ru", "детям", "ребенок"),
        ("ru", "платья", "платье"),
    ]
    return spark.createDataFrame(rows, "lang string, form string, lemma string")


@pytest.fixture(scope="module")
def clothes(spark):
    rows = [
        (0, "Одежда", "<b>Мужские</b> брюки"),
        (1, "Обувь", "для женскую, платья"),
        (2, "Белье", "мужские и женскую"),
        (3, "Одежда", "ничего"),
        (4, "Мебель", "мужские"),
        (5, "Одежда для малышей", "взрослый мужской"),
        (6, "Одежда", "Размер XXL"),
        (7, "Одежда", "Мальчик!"),
        (8, "Одежда", "детям и взрослый"),
        (9, "Одежда", None),
        (10, "Белье для малышей", None),
    ]
    return spark.createDataFrame(rows, "row_id long, category string, description string")


def as_dict(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len({r[0] for r in rows})
    return dict(rows)


def test_male_female(clothes, lemmas):
    assert as_dict(L.male_female(clothes, lemmas)) == {0: 1, 1: 0}


def test_adult_child(clothes, lemmas):
    assert as_dict(L.adult_child(clothes, lemmas)) == {0: 0, 1: 0, 2: 0, 5: 1, 6: 0, 7: 1, 10: 1}


def test_keyword_labelling_does_not_shuffle(clothes, lemmas, plan_of):
    plan = plan_of(L.male_female(clothes, lemmas))
    main = plan.split("Subquery")[0]
    assert "Exchange" not in main and "Python" not in plan


def test_texts_are_cleaned_once(spark, plan_of):
    texts = spark.createDataFrame([(0, "a b")], "row_id long, t string")
    tokens = texts.select("row_id", words(clean_text("t")).alias("tokens"))
    plan = plan_of(L.label_by_keywords(tokens, "tokens", ["a"], ["b"]))
    assert plan.count("regexp_replace") == 2


def test_word_lists_have_the_stated_sizes():
    assert len(L.CLOTHING_CATEGORIES) == 9 and len(L.MALE_WORDS) == 9
    assert len(L.FEMALE_WORDS) == 13 and len(L.CHILD_WORDS) == 9
    assert len(L.ADULT_WORDS) == 35 and len(set(L.ADULT_WORDS)) == 33


def test_exclusive_labels_and_difference(spark):
    df = spark.createDataFrame(
        [(0, ["a"]), (1, ["b"]), (2, ["a", "b"]), (3, []), (4, None)], "row_id long, t array<string>"
    )
    assert as_dict(L.label_by_keywords(df, "t", ["a"], ["b"])) == {0: 0, 1: 1}
    a, b = df.where("array_contains(t, 'a')"), df.where("array_contains(t, 'b')")
    assert [r.row_id for r in L.exclusive_ids(a, b).collect()] == [0]


def test_class_codes_follow_code_points(spark):
    df = spark.createDataFrame([("б",), ("a",), ("Я",), ("a",)], "target string")
    coded = L.class_codes(df).collect()
    assert {r.target: r.code for r in coded} == {"a": 0, "Я": 1, "б": 2}
    assert sorted(r.target for r in L.encode_classes(df).collect()) == [0, 0, 1, 2]


def replaced(rows, below=11, cascade=True):
    """Brute force over (position, sub, parent): one class after the other, in order."""
    rows = sorted(rows)
    current = {position: sub for position, sub, _ in rows}
    parent = {position: up for position, _, up in rows}
    sizes = {}
    for sub in current.values():
        sizes[sub] = sizes.get(sub, 0) + 1
    start = dict(current)
    for sub in sorted(s for s, n in sizes.items() if s is not None and n < below):
        seen = current if cascade else start
        members = [p for p in sorted(current) if seen[p] == sub]
        if members:
            for p in members:
                current[p] = parent[members[0]]
    return current


def rolled(spark, rows, **options):
    df = spark.createDataFrame(rows, "row_id long, sub_category string, category string").repartition(4)
    return {r.row_id: r.sub_category for r in L.roll_up_rare(df, **options).collect()}


def test_roll_up_boundary_first_row_and_nulls(spark):
    rows = [(i, "ten", "p" if i else "first") for i in range(10)]
    rows += [(100 + i, "eleven", "q") for i in range(11)]
    rows += [(200, None, "q"), (201, "orphan", None)]
    got = rolled(spark, rows)
    assert got == replaced(rows)
    assert got[5] == "first" and got[105] == "eleven" and got[200] is None and got[201] is None


@pytest.mark.parametrize("seed", range(3))
def test_roll_up_cascade_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(14)] + ["z"]
    rows = [(i, rng.choice(names), rng.choice(names)) for i in range(60)]
    rng.shuffle(rows)
    assert rolled(spark, rows, below=5) == replaced(rows, below=5)


def test_roll_up_long_chain(spark):
    names = [f"c{i}" for i in range(7)]
    rows = [(100 - i, names[i], names[i + 1]) for i in range(6)] + [(50, "c6", "end")]
    assert rolled(spark, rows) == replaced(rows)
    assert set(rolled(spark, rows).values()) == {"end"}


def test_roll_up_single_pass(spark):
    rows = [(0, "a", "b"), (1, "b", "c")]
    assert rolled(spark, rows, cascade=False) == {0: "b", 1: "c"}
    # In order of name, the rows of "a" join "b" first and then lead it.
    assert rolled(spark, rows) == replaced(rows) == {0: "b", 1: "b"}


def test_multiclass_labels(spark):
    vectors = spark.range(5).toDF("row_id")
    df = spark.createDataFrame([(4, "b"), (0, "a"), (4, "a")], "index long, target string")
    got = sorted(tuple(r) for r in L.multiclass_labels(df, vectors).collect())
    assert [r[0] for r in got] == [0, 1, 2] and got[0] == (0, 0)
    assert sorted(r[1] for r in got[1:]) == [0, 1]
    with pytest.raises(ValueError, match="target"):
        L.multiclass_labels(df.drop("target"), vectors)
    outside = df.union(spark.createDataFrame([(9, "c")], df.schema))
    with pytest.raises(Exception, match="outside the vector table"):
        L.multiclass_labels(outside, vectors).collect()


def test_gather_and_align(spark):
    vectors = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "row_id long, text array<float>")
    labels = spark.createDataFrame([(1, 0), (1, 1)], "row_id long, target int")
    for limit in (10**9, -1):
        out = J.gather(labels, vectors, limit_bytes=limit)
        assert out.columns == ["row_id", "target", "text"]
        assert sorted((r.row_id, r.target, r.text[0]) for r in out.collect()) == [(1, 0, 2.0), (1, 1, 2.0)]
        outside = labels.selectExpr("row_id + 1 AS row_id", "target")
        with pytest.raises(Exception, match="outside the vector table"):
            J.gather(outside, vectors, limit_bytes=limit)
        with pytest.raises(Exception, match="outside the vector table"):
            J.gather(labels.selectExpr("CAST(NULL AS long) AS row_id", "target"), vectors, limit_bytes=limit)
        repeated = vectors.union(vectors.where("row_id = 1"))
        with pytest.raises(ValueError, match="several vectors"):
            J.gather(labels, repeated, limit_bytes=limit)
        both = spark.createDataFrame([(1, 0), (2, 1)], "row_id long, target int")
        with pytest.raises(ValueError, match="several vectors"):
            J.gather(both, repeated, limit_bytes=limit)
        nothing = labels.where("false")
        assert J.gather(nothing, vectors, limit_bytes=limit).count() == 0
    whole = spark.createDataFrame([(0, 5), (1, 6)], "row_id long, target int")
    assert J.align(whole, vectors).count() == 2
    with pytest.raises(Exception, match="differ in their row positions"):
        J.align(whole.where("row_id = 0"), vectors).select("target").collect()
    with pytest.raises(ValueError, match="repeats"):
        J.align(whole.union(whole), vectors)
    with pytest.raises(ValueError, match="repeats"):
        J.align(vectors, whole.union(whole))


def test_small_labels_leave_the_vectors_in_place(spark, plan_of):
    vectors = spark.range(100).selectExpr("id AS row_id", "array(1.0f) AS text")
    labels = spark.range(10).selectExpr("id AS row_id", "1 AS target")
    plan = plan_of(J.gather(labels, vectors))
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    large = plan_of(J.gather(labels, vectors.hint("merge"), limit_bytes=-1))
    assert "SortMergeJoin" in large


def test_lookup_join_both_plans_agree_on_a_hot_key(spark, plan_of):
    rows = spark.range(3000).selectExpr("id", "IF(id < 2000, 'hot', concat('k', id % 50)) AS k", "id % 7 AS v")
    lookup = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(40)], "k string, x int")
    for how in ("left", "inner"):
        small = J.lookup_join(rows, lookup, ["k"], how)
        large = J.lookup_join(rows, lookup, ["k"], how, limit_bytes=-1, hot_rows=1000)
        assert "BroadcastHashJoin" in plan_of(small)
        assert "_salt" in plan_of(large)
        a = sorted(tuple(r) for r in small.select("id", "k", "v", "x").na.fill(-1).collect())
        b = sorted(tuple(r) for r in large.select("id", "k", "v", "x").na.fill(-1).collect())
        assert a == b and len(a) == (3000 if how == "left" else len(a))
    with pytest.raises(ValueError):
        J.lookup_join(rows, lookup, ["k"], "full_outer")


def test_only_hot_keys_are_sliced(spark, plan_of):
    """The rows of a hot key reach many tasks; other keys keep one lookup row."""
    key = "CASE WHEN id < 2500 THEN 'hot' WHEN id < 5000 THEN NULL ELSE concat('k', id % 50) END AS k"
    rows = spark.range(6000).selectExpr("id", key).repartition(8)
    lookup = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(50)], "k string, x int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = J.lookup_join(
            rows, lookup.hint("merge"), ["k"], limit_bytes=-1, hot_rows=1000, salts=32
        )
        assert "SortMergeJoin" in plan_of(joined)
        placed = joined.groupBy(F.spark_partition_id().alias("part"))
        sizes = [r.n for r in placed.agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 6000 and max(sizes) < 2000


def test_salt_spreads_copies_of_one_row(spark):
    copies = spark.range(8000).select(F.lit("hot").alias("k")).repartition(16)
    part, content = copy_spread(copies.columns)
    sizes = copies.groupBy(F.pmod(content + part, F.lit(64)).alias("s")).count().collect()
    assert len(sizes) >= 8


def test_measured_bytes_counts_strings_and_arrays(spark):
    df = spark.createDataFrame([("ab", [1.0, 2.0]), (None, None)], "s string, v array<double>")
    assert J.measured_bytes(df) == 2 * 16 + 2 + 16
    assert J.measured_bytes(df.limit(0)) == 0


def test_grid_and_append(spark):
    grid = J.run_grid(spark, ["m", "n"], ["t"])
    assert sorted(tuple(r) for r in grid.collect()) == [("m", "t"), ("n", "t")]
    assert J.append(grid, grid).count() == 4


def test_is_adult_and_sizes(spark):
    df = spark.createDataFrame([(0, True), (1, False), (2, True)], "row_id long, isadult boolean")
    assert as_dict(L.is_adult(df)) == {0: 1, 1: 0, 2: 1}
    assert as_dict(L.class_sizes(L.is_adult(df))) == {0: 1, 1: 2}
