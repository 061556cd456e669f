"""Price ranges, growing position tables and phrase lists, against plain versions."""

from __future__ import annotations

import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from shelfvec.operators.phrases import build_trie, drop_phrases, longest_matches
from shelfvec.operators.position_store import PositionStore
from shelfvec.operators.price_ranges import exact_bounds, price_classes


def plain_bounds(values, shares):
    values = sorted(values)
    n = len(values)
    return [values[min(max(math.ceil(q * n - 1e-9), 1), n) - 1] for q in shares]


@pytest.mark.parametrize("exact_rows", [100_000, 20, 1])
def test_bounds_are_exact_however_few_rows_are_counted(spark, exact_rows):
    draw = random.Random(1)
    values = [round(draw.lognormvariate(3, 2), 2) for _ in range(3000)] + [9.99] * 900 + [0.0, -5.0, 1e9]
    shares = [0.0, 0.001, 0.2, 0.25, 0.5, 0.75, 0.999, 1.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "price double").repartition(7)
    assert exact_bounds(df, "price", shares, accuracy=100, exact_rows=exact_rows) == plain_bounds(values, shares)


def test_classes_ties_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(i, float(i // 4)) for i in range(40)] + [(90, None), (91, float("nan"))], "id int, price double")
    got = {r.id: r.target for r in price_classes(df, "price", 5).collect()}
    bounds = plain_bounds([i // 4 for i in range(40)], [k / 5 for k in range(1, 5)])
    assert got == {**{i: sum(i // 4 > b for b in bounds) for i in range(40)}, 90: None, 91: None}
    assert {r.target for r in price_classes(df, "price", 1).where("id < 40").collect()} == {0}
    same = spark.createDataFrame([(1.0,)] * 9, "price double")
    assert {r.target for r in price_classes(same, "price", 3).collect()} == {0}
    assert price_classes(df.where("id < 0"), "price", 3).collect() == []
    with pytest.raises(ValueError):
        price_classes(df, "price", 0)


def numbered(store):
    return {r.key: (r.row_id, r.note) for r in store.positions().collect()}


def test_three_appends_equal_numbering_all_rows_anew(spark, tmp_path):
    draw = random.Random(4)
    keys = draw.sample(range(-5000, 5000), 400)
    parts = [keys[:150], keys[150:155], sorted(keys[155:300]), keys[300:]]
    frame = lambda part: spark.createDataFrame([(k, f"n{k}") for k in part], "key long, note string").repartition(3)
    store = PositionStore(spark, f"{tmp_path}/{uuid.uuid4().hex}", "key", range_rows=20)
    store.append(frame(parts[0]))
    seen = parts[0]
    for part in parts[1:]:
        store.append(frame(part))
        seen = seen + part
        assert numbered(store) == {k: (i, f"n{k}") for i, k in enumerate(sorted(seen))}
    assert store._fence().agg(F.max("rows")).first()[0] <= 40
    store.append(frame([]).where("key < 0"))
    before = numbered(store)
    store.drop_former()
    assert numbered(store) == before
    with pytest.raises(ValueError, match="repeats"):
        store.append(frame([keys[7]]))


def test_untouched_ranges_are_not_read(spark, tmp_path):
    store = PositionStore(spark, str(tmp_path), "key", range_rows=50)
    store.create(spark.range(0, 1000).select(F.col("id").alias("key")))
    added = store._with_range(spark.createDataFrame([(-5,), (3,), (10_000,)], "key long"))
    files = store.touched(added).inputFiles()
    ranges = {f.split("_range=")[1].split("/")[0] for f in files}
    assert len(ranges) == 2 and store._fence().count() >= 15
    strings = PositionStore(spark, f"{tmp_path}/strings", "key", range_rows=4)
    for part in (["pear", "apple", "fig", "kiwi", "é"], ["banana", "zoo", "a"], ["éa", "b"]):
        strings.append(spark.createDataFrame([(k,) for k in part], "key string"))
    got = [r.key for r in strings.positions().orderBy("row_id").collect()]
    assert got == sorted(["pear", "apple", "fig", "kiwi", "é", "banana", "zoo", "a", "éa", "b"], key=lambda s: s.encode())


def plain_drop(tokens, phrases):
    out, at = [], 0
    while at < len(tokens):
        size = max((len(p) for p in phrases if p and tokens[at : at + len(p)] == p), default=0)
        if not size:
            out.append(tokens[at])
        at += size or 1
    return " ".join(out)


@pytest.mark.parametrize("trie_bytes", [1 << 25, 200])
def test_phrases_longest_first_from_left_to_right(spark, trie_bytes):
    draw = random.Random(6)
    phrases = [[draw.choice("abcd") for _ in range(draw.randint(1, 4))] for _ in range(25)]
    phrases = [p for p in phrases if len(p) > 1 or p == ["d"]] + [["red", "shoe"], ["red", "shoe", "size"], []]
    lines = [" ".join(draw.choice("abcde") for _ in range(draw.randint(0, 30))) for _ in range(60)]
    lines += ["red shoe size red shoe", "red", "", "  red  shoe  x ", "Red shoe"]
    listed = spark.createDataFrame([(" ".join(p),) for p in phrases] + [("red shoe",), (None,), (" ",)], "phrase string")
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)] + [(999, None)], "id int, t string").repartition(3)
    got = {r.id: r.t for r in drop_phrases(df, "t", listed, trie_bytes=trie_bytes).collect()}
    assert got == {**{i: plain_drop(x.split(), phrases) for i, x in enumerate(lines)}, 999: None}
    assert drop_phrases(df, "t", listed.where("false"), "u").where("t <> u AND id < 60").count() == 0


def test_a_hundred_thousand_phrases_drop_what_fifty_do(spark, plan_of):
    few = [f"word{i} tail{i}" for i in range(50)]
    many = few + [f"never{i} seen{i} here" for i in range(100_000)]
    df = spark.createDataFrame([(i, f"a word{i} tail{i} z word{i}") for i in range(60)], "id int, t string")
    table = lambda rows: spark.createDataFrame([(r,) for r in rows], "phrase string")
    small, large = drop_phrases(df, "t", table(few)), drop_phrases(df, "t", table(many))
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    assert small.where("id = 3").first().t == "a z word3" and "Exchange" not in plan_of(large)


def test_trie_matches():
    trie = build_trie([["a"], ["a", "b", "c"], ["b"]])
    assert longest_matches(trie, ["a", "b", "x", "a", "b", "c"]) == [1, 1, 0, 3, 1, 0]


def test_only_tokens_that_begin_a_phrase_are_walked():
    class Counted(dict):
        asked = 0

        def get(self, *args):
            type(self).asked += 1
            return super().get(*args)

        def __getitem__(self, key):
            type(self).asked += 1
            return super().__getitem__(key)

    tokens = ["x"] * 5000 + ["a", "b", "c", "a"] + ["x"] * 5000
    found = longest_matches(Counted(build_trie([["a"], ["a", "b", "c"]])), tokens)
    assert found[4999:5005] == [0, 3, 0, 0, 1, 0] and sum(found) == 4
    assert Counted.asked <= 2
