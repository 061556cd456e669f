"""Product-shaped views of the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suite import table, text_table

# Titles and descriptions get nulls and blanks where products have them.
PRODUCTS_SQL = """
products AS (
  SELECT doc_id AS nm,
         CASE WHEN lang = 'es' THEN NULL WHEN lang = 'de' THEN chr(32) || chr(9)
              ELSE lang || ' ' || source END AS title,
         CASE WHEN source = 'src3' THEN NULL WHEN n_chars < 300 THEN chr(10) || chr(32)
              ELSE text END AS description,
         source AS category,
         source || '/' || lang AS sub_category,
         n_chars > 3000 AS isadult,
         lang AS brend
  FROM documents)
"""


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("nm"),
        F.when(F.col("lang") == "es", F.lit(None))
        .when(F.col("lang") == "de", F.lit(" \t"))
        .otherwise(F.concat("lang", F.lit(" "), "source"))
        .alias("title"),
        F.when(F.col("source") == "src3", F.lit(None))
        .when(F.col("n_chars") < 300, F.lit("\n "))
        .otherwise(F.col("text"))
        .alias("description"),
        F.col("source").alias("category"),
        F.concat("source", F.lit("/"), "lang").alias("sub_category"),
        (F.col("n_chars") > 3000).alias("isadult"),
        F.col("lang").alias("brend"),
    )


# Clothing texts: frequent words of the documents become inflected Russian ones.
CLOTHES_SQL = """
clothes AS (
  SELECT doc_id AS row_id,
         CASE lang WHEN 'en' THEN 'Одежда' WHEN 'fr' THEN 'Обувь'
                   WHEN 'de' THEN 'Одежда для малышей' ELSE 'Мебель' END AS category,
         replace(replace(replace(replace(text, ' the ', ' мужского '), ' le ', ' женская '),
                 ' de ', ' детские '), ' in ', ' Взрослых ') AS description
  FROM documents)
"""

LEMMA_ROWS = [
    ("ru", "мужского", "мужской"),
    ("ru", "женская", "женский"),
    ("ru", "детские", "детский"),
    ("ru", "взрослых", "взрослый"),
]


def clothes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_table(spark, sf_dir, "documents")
    text = F.col("text")
    for old, new in (
        (" the ", " мужского "), (" le ", " женская "), (" de ", " детские "), (" in ", " Взрослых "),
    ):
        text = F.replace(text, F.lit(old), F.lit(new))
    category = (
        F.when(F.col("lang") == "en", "Одежда")
        .when(F.col("lang") == "fr", "Обувь")
        .when(F.col("lang") == "de", "Одежда для малышей")
        .otherwise("Мебель")
    )
    return docs.select(
        F.col("doc_id").alias("row_id"), category.alias("category"), text.alias("description")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given vectors split into a text and an image half."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.slice("embedding", 1, 32).alias("text"),
        F.slice("embedding", 33, 32).alias("img"),
        F.col("label").alias("target"),
    )


# 8 x 8 grey pictures: each vector component scaled to a byte.
PIXELS_SQL = """
pixels AS (
  SELECT vec_id AS nm, (i // 8)::INT AS y, (i % 8)::INT AS x,
         greatest(0, least(255, floor((embedding[i + 1]::DOUBLE + 1) * 127.5)))::BIGINT AS v
  FROM embeddings, unnest(range(64)) AS r(i))
"""


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = F.transform(
        "embedding",
        lambda x: F.greatest(
            F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 1) * 127.5))
        ),
    )
    data = F.unhex(
        F.array_join(F.transform(byte, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), "")
    )
    image = F.struct(
        F.lit("").alias("origin"),
        F.lit(8).alias("height"),
        F.lit(8).alias("width"),
        F.lit(1).alias("nChannels"),
        F.lit(0).alias("mode"),
        data.alias("data"),
    )
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("nm"), image.alias("image"))
