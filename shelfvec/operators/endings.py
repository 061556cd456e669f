"""Lemmas of forms that no dictionary knows, by rules about their endings.

A rule says: a form with this ending loses so many letters and gains these. A
dictionary teaches the rules by counts: every form votes, at each of its own
endings, for the change that leads to its lemma. An ending keeps the change
with most votes if these are enough and most of that ending's forms agree.
The kept endings are a suffix trie; the longest one that a form has decides,
and endings that say the same as the next shorter one are pruned.

Learning is one aggregation of the dictionary, applying is one join of distinct
forms. Both are expressions; the rules' table grows with the number of endings,
not with the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfvec.functions.text import ALPHABETIC_PATTERN, as_column, lower_tokens
from shelfvec.operators.joins import lookup_join
from shelfvec.sources.scratch import materialize

# Longest ending, least votes of a rule, least share of its ending's forms, letters a form keeps.
MAX_ENDING = 6
MIN_VOTES = 3
MIN_SHARE = 0.6
MIN_STEM = 2


def common_prefix(a: Column | str, b: Column | str) -> Column:
    """Number of leading characters that two strings share."""
    a, b = as_column(a), as_column(b)
    least = F.least(F.length(a), F.length(b))
    # All shorter prefixes of an equal prefix are equal, so their number is its length.
    lengths = F.when(least > 0, F.sequence(F.lit(1), least)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(lengths, lambda n: F.substr(a, F.lit(1), n) == F.substr(b, F.lit(1), n)))


def _right(value: Column, n: Column) -> Column:
    return F.when(n == 0, F.lit("")).otherwise(F.substr(value, F.length(value) - n + 1, n))


def learn_endings(
    lemmas: DataFrame,
    max_ending: int = MAX_ENDING,
    min_votes: int = MIN_VOTES,
    min_share: float = MIN_SHARE,
    min_stem: int = MIN_STEM,
) -> DataFrame:
    """``lang, ending, cut, gain, votes`` from ``lang, form, lemma``, one form each.

    Of equally frequent changes the one that cuts less, then the first by
    spelling wins. Forms whose change reaches beyond ``max_ending`` letters vote
    for none, but count among their endings' forms.
    """
    entries = lemmas.where("lang IS NOT NULL AND form IS NOT NULL AND lemma IS NOT NULL")
    same = common_prefix("form", "lemma")
    changes = entries.select("lang", "form", "lemma", same.alias("same")).select(
        "lang",
        "form",
        (F.length("form") - F.col("same")).alias("cut"),
        F.substr("lemma", F.col("same") + 1).alias("gain"),
    )
    longest = F.least(F.length("form") - min_stem, F.lit(max_ending))
    at = F.when(longest >= 0, F.sequence(F.lit(0), longest)).otherwise(F.array().cast("array<int>"))
    seen = changes.select("lang", "form", "cut", "gain", F.explode(at).alias("n"))
    seen = seen.select("lang", _right(F.col("form"), F.col("n")).alias("ending"), "n", "cut", "gain")
    counted = seen.groupBy("lang", "ending", "n", "cut", "gain").agg(F.count("*").alias("votes"))
    # A row per ending and change: far fewer than forms.
    of_ending = Window.partitionBy("lang", "ending")
    order = of_ending.orderBy(F.desc("votes"), "cut", "gain")
    chosen = (
        counted.withColumn("total", F.sum("votes").over(of_ending))
        .where(F.col("cut") <= F.col("n"))
        .withColumn("place", F.row_number().over(order))
        .where((F.col("place") == 1) & (F.col("votes") >= min_votes) & (F.col("votes") >= min_share * F.col("total")))
    )
    chosen = materialize(chosen.select("lang", "ending", "n", "cut", "gain", "votes"), "endings")
    return _pruned(chosen)


def _pruned(chosen: DataFrame) -> DataFrame:
    """Without endings whose change is that of their longest kept shorter ending."""
    shorter = chosen.select(
        "lang", "ending", F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1))).alias("m")
    ).select("lang", "ending", "m", _right(F.col("ending"), F.col("m")).alias("above"))
    above = chosen.select(
        F.col("lang").alias("l"), F.col("ending").alias("above"), F.struct("n", "cut", "gain").alias("rule")
    )
    nearest = (
        shorter.join(above, (F.col("lang") == F.col("l")) & (shorter["above"] == above["above"]))
        .groupBy("lang", "ending")
        .agg(F.max("rule").alias("rule"))
    )
    same = (F.col("rule.cut") == F.col("cut")) & (F.col("rule.gain") == F.col("gain"))
    return (
        chosen.join(nearest, ["lang", "ending"], "left")
        .where(F.col("rule").isNull() | ~same)
        .select("lang", "ending", "cut", "gain", "votes")
    )


def guess_lemmas(
    forms: DataFrame, endings: DataFrame, max_ending: int = MAX_ENDING, min_stem: int = MIN_STEM
) -> DataFrame:
    """``lang, form, lemma`` of the distinct ``lang, form`` that have an ending with a rule."""
    longest = F.least(F.length("form") - min_stem, F.lit(max_ending))
    at = F.when(longest >= 0, F.sequence(F.lit(0), longest)).otherwise(F.array().cast("array<int>"))
    asked = forms.select("lang", "form", F.explode(at).alias("n"))
    asked = asked.withColumn("ending", _right(F.col("form"), F.col("n")))
    # The shortest endings are asked by every form: small tables are broadcast, hot endings salted.
    found = lookup_join(asked, endings.select("lang", "ending", "cut", "gain"), ["lang", "ending"], "inner")
    best = found.groupBy("lang", "form").agg(F.max(F.struct("n", "cut", "gain")).alias("rule"))
    stem = F.substr("form", F.lit(1), F.length("form") - F.col("rule.cut"))
    return best.select("lang", "form", F.concat(stem, F.col("rule.gain")).alias("lemma"))


def with_guesses(df: DataFrame, column: Column | str, language: Column, lemmas: DataFrame, endings: DataFrame) -> DataFrame:
    """The dictionary and, for alphabetic tokens of ``column`` that it lacks, lemmas by their endings.

    ``lemmas`` has one lemma per lower-case form. Tokens are reduced to distinct
    forms in the map tasks before they are shuffled.
    """
    named = df.select(language.alias("lang"), F.explode(lower_tokens(column)).alias("form"))
    forms = named.where(F.col("form").rlike(ALPHABETIC_PATTERN)).distinct()
    unknown = materialize(forms.join(lemmas, ["lang", "form"], "left_anti"), "unknown-forms")
    return lemmas.select("lang", "form", "lemma").unionByName(guess_lemmas(unknown, endings))
