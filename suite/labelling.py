"""Label tables and joins by position."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfvec.functions.text import clean_text, words
from shelfvec.operators import labels as L
from shelfvec.operators.joins import align, gather, run_grid
from shelfvec.operators.numbering import with_positions
from suite import query, table, text_table
from suite.texts import clean_sql, list_sql, tokens_sql
from suite.views import CLOTHES_SQL, LEMMA_ROWS, clothes, vectors

ZERO, ONE = ["the", "and"], ["le", "de"]

HITS_SQL = f"""
hits AS (SELECT doc_id AS row_id, list_has_any(tokens, {list_sql(ZERO)}) AS zero,
                list_has_any(tokens, {list_sql(ONE)}) AS one
         FROM (SELECT doc_id, {tokens_sql(clean_sql("lower(text)"))} AS tokens FROM documents))
"""


def _tokens(spark, sf):
    return text_table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), words(clean_text(F.lower("text"))).alias("tokens")
    )


@query(
    "l1_exclusive_labels",
    f"WITH {HITS_SQL} SELECT row_id, one::INT AS target FROM hits WHERE zero <> one",
)
def l1(spark, sf):
    return L.label_by_keywords(_tokens(spark, sf), "tokens", ZERO, ONE)


@query(
    "l8_class_sizes",
    f"""WITH {HITS_SQL}
        SELECT one::INT AS target, count(*) AS n FROM hits WHERE zero <> one GROUP BY ALL""",
)
def l8(spark, sf):
    return L.class_sizes(l1(spark, sf))


def _lemma_table(spark):
    return spark.createDataFrame(LEMMA_ROWS, "lang string, form string, lemma string")


def _lemma_hits_sql(zero_words, one_words):
    mapping = ", ".join(f"('{form}', '{lemma}')" for _, form, lemma in LEMMA_ROWS)
    return f"""
      {CLOTHES_SQL},
      lemmas(form, lemma) AS (VALUES {mapping}),
      tokens AS (SELECT row_id, unnest({tokens_sql(clean_sql("lower(description)"))}) AS token
                 FROM clothes WHERE category IN ({", ".join(f"'{c}'" for c in L.CLOTHING_CATEGORIES)})),
      marked AS (SELECT row_id, bool_or(list_contains({list_sql(zero_words)}, w)) AS zero,
                        bool_or(list_contains({list_sql(one_words)}, w)) AS one
                 FROM (SELECT row_id, coalesce(lemma, token) AS w
                       FROM tokens LEFT JOIN lemmas ON form = token) GROUP BY row_id)"""


@query(
    "l2_male_female",
    f"""WITH {_lemma_hits_sql(L.FEMALE_WORDS, L.MALE_WORDS)}
        SELECT row_id, one::INT AS target FROM marked WHERE zero <> one""",
)
def l2(spark, sf):
    return L.male_female(clothes(spark, sf), _lemma_table(spark))


@query(
    "l3_adult_child",
    f"""WITH {_lemma_hits_sql(L.ADULT_WORDS, L.CHILD_WORDS)}
        SELECT row_id, one::INT AS target FROM marked WHERE zero <> one
        UNION ALL
        SELECT row_id, 1 AS target FROM clothes
        WHERE category IN ('Одежда для малышей', 'Белье для малышей')""",
)
def l3(spark, sf):
    return L.adult_child(clothes(spark, sf), _lemma_table(spark))


@query(
    "l4_is_adult",
    """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, toxic AS target FROM labels""",
)
def l4(spark, sf):
    flags = table(spark, sf, "labels").select("doc_id", (F.col("toxic") == 1).alias("isadult"))
    return L.is_adult(with_positions(flags, ["doc_id"]))


@query(
    "l5_class_codes",
    "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand) - 1)::INT AS target FROM part",
)
def l5(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("target"))
    return L.encode_classes(part)


@query(
    "l6_roll_up_rare",
    """WITH p AS (SELECT p_partkey AS row_id, p_type AS category,
                         p_brand || '/' || p_type AS sub_category FROM part),
       s AS (SELECT sub_category, count(*) AS n, arg_min(category, row_id) AS rep
             FROM p GROUP BY sub_category)
       SELECT row_id, category, CASE WHEN n < 11 THEN rep ELSE sub_category END AS sub_category
       FROM p JOIN s USING (sub_category)""",
)
def l6(spark, sf):
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("row_id"),
        F.col("p_type").alias("category"),
        F.concat("p_brand", F.lit("/"), "p_type").alias("sub_category"),
    )
    return L.roll_up_rare(part)


@query(
    "l7_multiclass_labels",
    """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id,
              (dense_rank() OVER (ORDER BY lang) - 1)::INT AS target
       FROM labels JOIN documents USING (doc_id)""",
)
def l7(spark, sf):
    docs = table(spark, sf, "documents")
    listed = table(spark, sf, "labels").join(docs, "doc_id")
    return L.multiclass_labels(
        listed.select(F.col("doc_id").alias("index"), F.col("lang").alias("target")),
        docs.select(F.col("doc_id").alias("row_id")),
    )


@query(
    "j1_gather",
    """SELECT doc_id AS row_id, toxic AS target, i AS place, embedding[i + 1] AS text,
              embedding[i + 33] AS img
       FROM labels JOIN embeddings ON doc_id % (SELECT count(*) FROM embeddings) = vec_id,
            unnest(range(32)) r(i)""",
)
def j1(spark, sf):
    """All labels; every document has one of the given vectors, in turn."""
    given = vectors(spark, sf).drop("target").withColumnRenamed("row_id", "vec_id")
    place = F.col("doc_id") % F.lit(given.count())
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), place.alias("vec_id"))
    store = docs.join(given, "vec_id").drop("vec_id")
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").alias("row_id"), F.col("toxic").alias("target")
    )
    pairs = F.posexplode(F.arrays_zip("text", "img")).alias("place", "pair")
    return gather(labels, store).select("row_id", "target", pairs).select(
        "row_id", "target", F.col("place").cast("long").alias("place"), "pair.text", "pair.img"
    )


@query(
    "j2_align",
    """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, lang, n_chars FROM documents""",
)
def j2(spark, sf):
    docs = table(spark, sf, "documents")
    numbered = with_positions(docs.select("doc_id", "lang", "n_chars"), ["doc_id"])
    return align(numbered.select("row_id", "lang"), numbered.select("row_id", "n_chars"))


@query(
    "j3_run_grid",
    """SELECT m.model, t.task, count(l.l_orderkey) AS n
       FROM (VALUES ('A'), ('N'), ('R'), ('X')) m(model) CROSS JOIN (VALUES ('F'), ('O')) t(task)
       LEFT JOIN lineitem l ON l.l_returnflag = m.model AND l.l_linestatus = t.task
       GROUP BY ALL""",
)
def j3(spark, sf):
    found = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("task"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Two short lists of names that the caller holds; one of them has no rows.
    grid = run_grid(spark, ["A", "N", "R", "X"], ["F", "O"])
    return grid.join(found, ["model", "task"], "left").na.fill(0, ["n"])


@query(
    "j6_difference",
    f"WITH {HITS_SQL} SELECT row_id FROM hits WHERE zero AND NOT one",
)
def j6(spark, sf):
    tokens = _tokens(spark, sf)
    hits = [tokens.where(L.shares_word("tokens", w)).select("row_id") for w in (ZERO, ONE)]
    return L.exclusive_ids(*hits)
