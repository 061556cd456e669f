"""Ending rules against counts in plain Python, and on forms that were held out."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from shelfvec.operators import endings as E
from shelfvec.operators.language import normalize_text

STEMS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("l", "nd", "rt", "m", "ck")]


def english(seed=1):
    """Plurals and past forms of invented words, a few of them irregular."""
    draw = random.Random(seed)
    rows = []
    for stem in STEMS:
        rows += [(stem + "s", stem), (stem + "ed", stem), (stem + "ing", stem)]
        if draw.random() < 0.5:
            rows += [(stem + "ies", stem + "y"), (stem + "y", stem + "y")]
    rows += [("mice", "mouse"), ("went", "go"), ("is", "be"), ("ox", "ox")]
    return sorted(set(rows))


def plain_rules(rows):
    votes, totals = Counter(), Counter()
    for form, lemma in rows:
        same = 0
        while same < min(len(form), len(lemma)) and form[same] == lemma[same]:
            same += 1
        for n in range(0, min(len(form) - E.MIN_STEM, E.MAX_ENDING) + 1):
            ending = form[len(form) - n :]
            votes[ending, len(form) - same, lemma[same:]] += 1
            totals[ending] += 1
    best = {}
    for (ending, cut, gain), n in sorted(votes.items(), key=lambda x: (-x[1], x[0][1], x[0][2])):
        if cut <= len(ending) and ending not in best:
            best[ending] = (cut, gain, n)
    kept = {e: (c, g) for e, (c, g, n) in best.items() if n >= E.MIN_VOTES and n >= E.MIN_SHARE * totals[e]}

    def above(ending):
        return next((kept[ending[i:]] for i in range(1, len(ending) + 1) if ending[i:] in kept), None)

    return {e: rule for e, rule in kept.items() if above(e) != rule}


def guess(form, rules):
    for i in range(max(E.MIN_STEM, len(form) - E.MAX_ENDING), len(form) + 1):
        if form[i:] in rules:
            cut, gain = rules[form[i:]]
            return form[: len(form) - cut] + gain
    return None


def table(spark, rows, lang="en"):
    return spark.createDataFrame([(lang, f, x) for f, x in rows], "lang string, form string, lemma string")


def test_rules_and_guesses_equal_plain_counts(spark):
    rows = english()
    draw = random.Random(2)
    known = [r for r in rows if draw.random() < 0.8]
    held = [r for r in rows if r not in known]
    learned = E.learn_endings(table(spark, known).repartition(5))
    rules = plain_rules(known)
    assert {r.ending: (r.cut, r.gain) for r in learned.collect()} == rules
    asked = table(spark, held).select("lang", "form")
    got = {r.form: r.lemma for r in E.guess_lemmas(asked, learned).collect()}
    assert got == {f: guess(f, rules) for f, _ in held if guess(f, rules) is not None}
    right = sum(got.get(f) == lemma for f, lemma in held) / len(held)
    assert right >= 0.95


def test_languages_nulls_ties_and_short_forms(spark):
    rows = [("en", f"x{c}es", f"x{c}") for c in "abcd"] + [("ru", f"ж{c}ая", f"ж{c}ый") for c in "бвгд"]
    rows += [(None, "a", "b"), ("en", None, "b"), ("en", "a", None), ("en", "s", "s"), ("en", "", "")]
    df = spark.createDataFrame(rows, "lang string, form string, lemma string")
    learned = E.learn_endings(df)
    asked = spark.createDataFrame([("en", "qqes"), ("ru", "ккая"), ("ru", "qqes"), ("en", "es"), ("en", "s"), ("de", "qqes")], "lang string, form string")
    got = {(r.lang, r.form): r.lemma for r in E.guess_lemmas(asked, learned).collect()}
    assert got == {("en", "qqes"): "qq", ("ru", "ккая"): "ккый"}
    none = spark.createDataFrame([], "lang string, form string, lemma string")
    assert E.learn_endings(none).collect() == [] and E.guess_lemmas(asked, E.learn_endings(none)).collect() == []


@pytest.mark.parametrize("limit", [1 << 25, -1])
def test_texts_follow_the_rules_for_unknown_forms_alone(spark, limit):
    known = [("foxes", "fox"), ("boxes", "boxen")] + [(s + "es", s) for s in ("wax", "mix", "fax", "six")]
    lemmas = table(spark, known)
    text = spark.createDataFrame([(1, "Boxes taxes FOXES 12es es"), (2, None), (3, "")], "id int, t string")
    out = normalize_text(text, "t", lemmas, "en", limit_bytes=limit, endings=E.learn_endings(lemmas))
    assert {r.id: r.t for r in out.collect()} == {1: "boxen tax fox es", 2: None, 3: ""}


def test_a_computed_text_is_computed_once(spark):
    """Its forms and its lines are both read from the stored text."""
    from pyspark.sql import functions as F

    from shelfvec.operators.endings import learn_endings
    from shelfvec.operators.language import normalize_text

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def said(n):
        seen.add(1)
        return f"tables of word{'s' * (n % 2)} chairs"

    known = spark.createDataFrame([("en", f"{w}s", w) for w in ("table", "door", "tree", "house")], "lang string, form string, lemma string")
    df = spark.range(20).select("id", said("id").alias("line"))
    out = {r.id: r.line for r in normalize_text(df, "line", known, language="en", endings=learn_endings(known)).collect()}
    assert out[0] == "table of word chair" and out[1] == "table of word chair" and len(out) == 20
    assert seen.value == 20
