"""Text cleaning, language and lemmas."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfvec.functions.text import clean_text, shares_word, words
from shelfvec.operators.phrases import drop_phrases
from shelfvec.operators.endings import MAX_ENDING, MIN_SHARE, MIN_STEM, MIN_VOTES, learn_endings
from shelfvec.operators.language import (
    language_of_column,
    language_of_row,
    normalize_columns,
    normalize_text,
)
from shelfvec.sources.scratch import materialize
from suite import query, text_table

SPACE_SQL = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
# The first phrase occurs with one space; the second only with two, and stays.
DROP = ["div", "the", "html lang", "charset utf", "li"]


def collapse_sql(text):
    return rf"trim(regexp_replace({text}, '[{SPACE_SQL}]+', ' ', 'g'), ' ')"


def strip_sql(text):
    tagless = f"regexp_replace({text}, '<[^>]+>', ' ', 'g')"
    return rf"regexp_replace({tagless}, '[^\p{{L}}\p{{N}}_{SPACE_SQL}]', ' ', 'g')"


def clean_sql(text):
    return collapse_sql(strip_sql(text))


def tokens_sql(text):
    return f"list_filter(string_split({text}, ' '), lambda w: w <> '')"


def list_sql(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query("t1_clean_text", f"SELECT page_id, {clean_sql('html')} AS clean FROM pages")
def t1(spark, sf):
    return text_table(spark, sf, "pages").select("page_id", clean_text("html").alias("clean"))


# Attributes become text, so that words inside former tags are dropped too.
OPENED_SQL = "replace(replace(html, '<', ' '), '>', ' ')"


def drop_sql(text, dropped):
    """Words and phrases dropped one after the other, before spaces collapse.

    RE2 has no look-around. Every space is doubled, so that neighbouring words
    do not share one, and a dropped word leaves the halves of one more space.
    """
    text = f"' ' || regexp_replace({text}, '([{SPACE_SQL}])', '\\1\\1', 'g') || ' '"
    for word in dropped:
        pattern = f"[{SPACE_SQL}]{word.replace(' ', '  ')}[{SPACE_SQL}]"
        text = f"regexp_replace({text}, '{pattern}', '    ', 'g')"
    return collapse_sql(text)


@query(
    "t2_drop_words",
    f"SELECT page_id, {drop_sql(strip_sql(OPENED_SQL), DROP)} AS clean FROM pages",
)
def t2(spark, sf):
    opened = F.replace(F.replace("html", F.lit("<"), F.lit(" ")), F.lit(">"), F.lit(" "))
    return text_table(spark, sf, "pages").select("page_id", clean_text(opened, DROP).alias("clean"))


# Phrases taken from the corpus: what follows "the" and "de", and pairs of such.
PHRASES_SQL = f"""
cleaned AS (SELECT doc_id, {tokens_sql(clean_sql("text"))} AS tokens FROM documents),
placed AS (SELECT doc_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS pos FROM cleaned),
heads AS (SELECT a.doc_id, a.pos, a.token AS a, b.token AS b, c.token AS c FROM placed a
          JOIN placed b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1
          JOIN placed c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2 WHERE a.token IN ('the', 'de')),
phrases AS (SELECT a || ' ' || b AS phrase FROM heads WHERE length(b) <= 3
            UNION SELECT a || ' ' || b || ' ' || c FROM heads WHERE length(b) <= 3 AND length(c) = 2)
"""


@query(
    "t2_drop_phrases",
    f"""WITH {PHRASES_SQL},
        pattern AS (SELECT ' (?:' || string_agg(replace(phrase, ' ', '  '), '|' ORDER BY len(phrase) - len(replace(phrase, ' ', '')) DESC, phrase) || ') ' AS p
                    FROM phrases)
        SELECT doc_id, trim(regexp_replace(regexp_replace(' ' || array_to_string(tokens, '  ') || ' ', p, '', 'g'), ' +', ' ', 'g'), ' ') AS clean
        FROM cleaned, pattern""",
)
def t2_phrases(spark, sf):
    """Phrases of two and three words dropped, the longest first."""
    docs = text_table(spark, sf, "documents").select("doc_id", clean_text("text").alias("clean"))
    tokens = words("clean")
    heads = docs.select(F.explode(F.arrays_zip(tokens.alias("a"), F.slice(tokens, 2, 1 << 30).alias("b"), F.slice(tokens, 3, 1 << 30).alias("c"))).alias("h"))
    heads = heads.select("h.*").where(F.col("a").isin("the", "de") & F.col("c").isNotNull() & (F.length("b") <= 3))
    two = heads.select(F.concat_ws(" ", "a", "b").alias("phrase"))
    three = heads.where(F.length("c") == 2).select(F.concat_ws(" ", "a", "b", "c").alias("phrase"))
    return drop_phrases(docs, "clean", two.union(three).distinct())


# German rows are spelled with Cyrillic vowels.
MIXED_SQL = "CASE WHEN lang = 'de' THEN translate(text, 'aeo', 'аео') ELSE text END"


def _mixed(spark, sf):
    text = F.when(F.col("lang") == "de", F.translate("text", "aeo", "аео")).otherwise(F.col("text"))
    return text_table(spark, sf, "documents").select("doc_id", text.alias("text"))


@query(
    "t3_language",
    rf"""WITH mixed AS (
          SELECT doc_id, regexp_matches({MIXED_SQL}, '[а-яА-ЯёЁ]') AS found FROM documents)
        SELECT doc_id, CASE WHEN found THEN 'ru' ELSE 'en' END AS row_language,
               CASE WHEN (SELECT bool_or(found) FROM mixed) THEN 'ru' ELSE 'en' END AS language
        FROM mixed""",
)
def t3(spark, sf):
    mixed = _mixed(spark, sf)
    return mixed.select(
        "doc_id",
        language_of_row("text").alias("row_language"),
        language_of_column(mixed, "text").alias("language"),
    )


# A dictionary taken from the corpus: plural and e-forms lose their ending.
LEMMAS_SQL = f"""
lemmas AS (
  SELECT DISTINCT lower(form) AS form, regexp_replace(lower(form), '(es|s|e)$', '') AS lemma
  FROM (SELECT unnest({tokens_sql(clean_sql('text'))}) AS form FROM documents)
  WHERE regexp_matches(form, '..(s|e)$'))
"""


def _lemmas(spark, sf):
    docs = text_table(spark, sf, "documents")
    forms = docs.select(F.explode(words(clean_text("text"))).alias("form"))
    return (
        forms.where(F.col("form").rlike("..(s|e)$"))
        .select(F.lit("en").alias("lang"), F.lower("form").alias("form"))
        .distinct()
        .withColumn("lemma", F.regexp_replace("form", "(es|s|e)$", ""))
    )


def normalized_sql(key, text, source):
    return rf"""
      tokens AS (SELECT {key}, unnest({tokens_sql(text)}) AS token,
                        unnest(range(len({tokens_sql(text)}))) AS pos FROM {source}),
      found AS (SELECT {key}, pos, lower(token) AS form, coalesce(l.lemma, lower(token)) AS lemma
                FROM tokens LEFT JOIN lemmas l ON l.form = lower(token)),
      lines AS (SELECT {key}, string_agg(lemma, ' ' ORDER BY pos) AS line FROM found
                WHERE regexp_matches(form, '^\p{{L}}+$') GROUP BY {key})"""


@query(
    "t4_normalize_text",
    f"""WITH {LEMMAS_SQL},
        cleaned AS (SELECT doc_id, {clean_sql("text")} AS clean FROM documents),
        {normalized_sql("doc_id", "clean", "cleaned")}
        SELECT doc_id, coalesce(line, '') AS line FROM documents LEFT JOIN lines USING (doc_id)""",
)
def t4(spark, sf):
    cleaned = text_table(spark, sf, "documents").select("doc_id", clean_text("text").alias("line"))
    return normalize_text(cleaned, "line", _lemmas(spark, sf), language="en")


# A fifth of the dictionary's forms is held out; the rest teaches the endings.
HELD_OUT_SQL = "substr(md5(form), 1, 1) IN ('0', '1', '2')"
ENDINGS_SQL = f"""
known AS (SELECT * FROM lemmas WHERE NOT {HELD_OUT_SQL}),
changes AS (
  SELECT form, lemma, (SELECT count(*) FROM range(1, least(len(form), len(lemma)) + 1) r(i)
                       WHERE left(form, i) = left(lemma, i)) AS same FROM known),
votes AS (
  SELECT right(form, n) AS ending, n, len(form) - same AS cut, substr(lemma, same + 1) AS gain, count(*) AS votes
  FROM changes, range({MAX_ENDING} + 1) r(n) WHERE n <= len(form) - {MIN_STEM} GROUP BY ALL),
ranked AS (SELECT *, sum(votes) OVER (PARTITION BY ending) AS total FROM votes),
best AS (
  SELECT * FROM ranked WHERE cut <= n
  QUALIFY row_number() OVER (PARTITION BY ending ORDER BY votes DESC, cut, gain) = 1),
rules AS (SELECT * FROM best WHERE votes >= {MIN_VOTES} AND votes >= {MIN_SHARE} * total),
endings AS (
  SELECT r.ending, r.cut, r.gain, r.votes FROM rules r
  LEFT JOIN rules s ON s.n < r.n AND s.ending = right(r.ending, s.n)
  GROUP BY ALL
  HAVING count(s.n) = 0 OR arg_max(s.cut, s.n) <> r.cut OR arg_max(s.gain, s.n) <> r.gain)
"""


def _held_out(form):
    return F.substring(F.md5(form), 1, 1).isin("0", "1", "2")


@query(
    "t4_ending_rules",
    f"""WITH {LEMMAS_SQL}, {ENDINGS_SQL}
        SELECT 'en' AS lang, ending, cut::INT AS cut, gain, votes FROM endings""",
)
def t4_rules(spark, sf):
    """The rules that four fifths of the dictionary teach."""
    return learn_endings(_lemmas(spark, sf).where(~_held_out("form")))


@query(
    "t4_unknown_forms",
    f"""WITH {LEMMAS_SQL}, {ENDINGS_SQL},
        cleaned AS (SELECT doc_id, {clean_sql("text")} AS clean FROM documents),
        forms AS (SELECT DISTINCT lower(token) AS form
                  FROM (SELECT unnest({tokens_sql("clean")}) AS token FROM cleaned)
                  WHERE regexp_matches(lower(token), '^\\p{{L}}+$')),
        guessed AS (
          SELECT form, arg_max(left(form, len(form) - cut) || gain, len(ending)) AS lemma
          FROM forms JOIN endings ON ends_with(form, ending) AND len(ending) <= len(form) - {MIN_STEM}
          WHERE form NOT IN (SELECT form FROM known) GROUP BY form),
        dictionary AS (SELECT form, lemma FROM known UNION ALL SELECT form, lemma FROM guessed),
        {normalized_sql("doc_id", "clean", "cleaned").replace("JOIN lemmas l", "JOIN dictionary l")}
        SELECT doc_id, coalesce(line, '') AS line FROM documents LEFT JOIN lines USING (doc_id)""",
)
def t4_unknown(spark, sf):
    """Texts lemmatised by the smaller dictionary, forms it lacks by their endings."""
    known = materialize(_lemmas(spark, sf).where(~_held_out("form")), "known-forms")
    cleaned = text_table(spark, sf, "documents").select("doc_id", clean_text("text").alias("line"))
    return normalize_text(cleaned, "line", known, language="en", endings=learn_endings(known))


@query(
    "t5_normalize_columns",
    f"""WITH {LEMMAS_SQL},
        cleaned AS (SELECT page_id, {clean_sql("html")} AS clean FROM pages),
        {normalized_sql("page_id", "clean", "cleaned")}
        SELECT page_id, html, coalesce(line, '') AS clear_html
        FROM pages LEFT JOIN lines USING (page_id)""",
)
def t5(spark, sf):
    pages = text_table(spark, sf, "pages").select("page_id", "html")
    return normalize_columns(pages, ["html"], _lemmas(spark, sf), ["clear_html"])


@query(
    "t6_tokens",
    f"""WITH cleaned AS (SELECT doc_id, {tokens_sql(clean_sql("text"))} AS tokens FROM documents)
        SELECT doc_id, len(tokens)::INT AS n_tokens, tokens[1] AS first_token,
               tokens[-1] AS last_token, array_to_string(tokens, '|') AS joined
        FROM cleaned""",
)
def t6(spark, sf):
    docs = text_table(spark, sf, "documents").select("doc_id", words(clean_text("text")).alias("tokens"))
    return docs.select(
        "doc_id",
        F.size("tokens").alias("n_tokens"),
        F.get("tokens", F.lit(0)).alias("first_token"),
        F.try_element_at("tokens", F.lit(-1)).alias("last_token"),
        F.array_join("tokens", "|").alias("joined"),
    )


@query(
    "t7_shares_word",
    f"""SELECT doc_id,
               list_has_any({tokens_sql(clean_sql("lower(text)"))}, {list_sql(["the", "and"])}) AS hit
        FROM documents""",
)
def t7(spark, sf):
    tokens = words(clean_text(F.lower("text")))
    return text_table(spark, sf, "documents").select(
        "doc_id", shares_word(tokens, ["the", "and"]).alias("hit")
    )
