"""Sources, sinks, filters, projections and numbering."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfvec.operators import numbering as N
from shelfvec.operators import prepare as P
from shelfvec.operators.joins import append
from shelfvec.operators.position_store import PositionStore
from shelfvec.plans.preparation import prepare_catalog, prepare_training, prepared_columns
from shelfvec.sources.products import read_products, read_splits
from shelfvec.sources.scratch import fresh_path
from shelfvec.sources.tables import read_csv, write_csv
from shelfvec.sources.vectors import read_vectors, write_vectors
from suite import query, table
from suite.views import PRODUCTS_SQL, products, vectors

BLANK_SQL = r"'^[\s\x0b\x1c-\x1f\x{85}\p{Z}]*$'"


@query("s1_read_products", f"WITH {PRODUCTS_SQL} SELECT * FROM products")
def s1(spark, sf):
    path = fresh_path(spark, "products")
    products(spark, sf).write.parquet(path)
    return read_products(spark, path)


@query(
    "s2_read_splits",
    """SELECT 'train' AS split, text FROM documents
       UNION ALL SELECT 'test' AS split, text FROM benchmark""",
)
def s2(spark, sf):
    schema = T.StructType([T.StructField("text", T.StringType())])
    paths = {"train": f"{sf}/documents.parquet", "test": f"{sf}/benchmark.parquet"}
    return read_splits(spark, paths, schema)


@query("s3_s4_csv_round_trip", "SELECT page_id, url, html FROM pages")
def s3(spark, sf):
    path = fresh_path(spark, "csv")
    write_csv(table(spark, sf, "pages"), path)
    return read_csv(spark, path, "page_id long, url string, html string")


@query(
    "s5_s6_vector_store",
    """SELECT vec_id AS row_id, 'base' AS model, i AS place, embedding[i + 1] AS text,
              embedding[i + 33] AS img
       FROM embeddings, unnest(range(32)) r(i)""",
)
def s5(spark, sf):
    path = fresh_path(spark, "store")
    base = vectors(spark, sf)
    swapped = base.select("row_id", F.col("img").alias("text"), F.col("text").alias("img"))
    write_vectors(base.withColumn("model", F.lit("base")), path)
    write_vectors(swapped.withColumn("model", F.lit("swapped")), path)
    pairs = F.posexplode(F.arrays_zip("text", "img")).alias("place", "pair")
    return read_vectors(spark, path, ["base"]).select("row_id", "model", pairs).select(
        "row_id", "model", F.col("place").cast("long").alias("place"), "pair.text", "pair.img"
    )


@query("p1_drop_null_title", f"WITH {PRODUCTS_SQL} SELECT nm, title FROM products WHERE title IS NOT NULL")
def p1(spark, sf):
    return P.drop_null(products(spark, sf), "title").select("nm", "title")


@query(
    "p2_fill_blanks",
    f"""WITH {PRODUCTS_SQL}
        SELECT nm,
               CASE WHEN regexp_matches(title, {BLANK_SQL}) THEN 'No info' ELSE title END AS title,
               CASE WHEN regexp_matches(description, {BLANK_SQL}) THEN 'No info'
                    ELSE description END AS description
        FROM products""",
)
def p2(spark, sf):
    return P.fill_blanks(products(spark, sf)).select("nm", "title", "description")


@query(
    "p3_drop_null_description",
    f"""WITH {PRODUCTS_SQL}
        SELECT nm, CASE WHEN regexp_matches(description, {BLANK_SQL}) THEN 'No info'
                        ELSE description END AS description
        FROM products WHERE description IS NOT NULL""",
)
def p3(spark, sf):
    return P.drop_null(P.fill_blanks(products(spark, sf)), "description").select("nm", "description")


@query("p4_drop_ids", "SELECT doc_id AS nm, lang FROM documents WHERE doc_id <> 87")
def p4(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("nm"), "lang")
    return P.drop_ids(docs, ids=[87])


@query(
    "p5_drop_listed",
    """SELECT doc_id AS nm, lang FROM documents
       WHERE doc_id NOT IN (SELECT page_id FROM pages)""",
)
def p5(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("nm"), "lang")
    names = table(spark, sf, "pages").select(
        F.concat(F.col("page_id").cast("string"), F.lit(".jpg")).alias("monochrome_img")
    )
    return P.drop_listed(docs, names)


@query(
    "p6_drop_incomplete",
    f"""WITH {PRODUCTS_SQL}
        SELECT nm, title FROM products WHERE title IS NOT NULL AND description IS NOT NULL""",
)
def p6(spark, sf):
    return P.drop_incomplete(products(spark, sf)).select("nm", "title")


@query("p7_drop_columns", "SELECT p_partkey AS nm, p_name AS title FROM part")
def p7(spark, sf):
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("nm"),
        F.col("p_name").alias("title"),
        F.col("p_retailprice").alias("price"),
        F.col("p_partkey").alias("Unnamed: 0"),
    )
    return P.drop_unnamed_index(P.drop_columns(part))


@query("p8_decode_bytes", "SELECT doc_id AS nm, text AS characteristics FROM documents")
def p8(spark, sf):
    docs = table(spark, sf, "documents")
    encoded = docs.select(
        F.col("doc_id").alias("nm"), F.encode("text", "UTF-8").alias("characteristics")
    )
    return P.decode_bytes(encoded)


@query(
    "p9_image_path",
    "SELECT doc_id AS nm, '/images/' || doc_id::VARCHAR || '.jpg' AS image_path FROM documents",
)
def p9(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("nm"))
    return docs.withColumn("image_path", P.image_path("/images"))


@query(
    "p10_rewrite_paths",
    r"SELECT page_id, replace(url, 'https://', '\\store\.new/') AS image_path FROM pages",
)
def p10(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.col("url").alias("image_path"))
    return P.rewrite_paths(pages, "https://", r"\\store\.new/")


@query(
    "p11_prepared_catalog",
    rf"""WITH {PRODUCTS_SQL}
        SELECT nm,
               CASE WHEN regexp_matches(title, {BLANK_SQL}) THEN 'No info' ELSE title END AS title,
               'C:\full\' || nm::VARCHAR || '.jpg' AS image_path
        FROM products
        WHERE title IS NOT NULL AND description IS NOT NULL AND nm <> 87996913""",
)
def p11(spark, sf):
    return prepared_columns(prepare_catalog(products(spark, sf), "C:\\full", separator="\\"))


@query(
    "p6_p8_prepared_training",
    f"""WITH {PRODUCTS_SQL}
        SELECT nm, title, description, brend || category AS characteristics,
               '/train/' || nm::VARCHAR || '.jpg' AS image_path
        FROM products
        WHERE title IS NOT NULL AND description IS NOT NULL
          AND nm NOT IN (SELECT page_id FROM pages)""",
)
def p6_p8(spark, sf):
    rows = products(spark, sf).select(
        "nm",
        "title",
        "description",
        F.lit(1.0).alias("price"),
        F.encode(F.concat("brend", "category"), "UTF-8").alias("characteristics"),
    )
    listed = table(spark, sf, "pages").select(
        F.concat(F.col("page_id").cast("string"), F.lit(".png")).alias("monochrome_img")
    )
    return prepare_training(rows, "/train", listed)


@query(
    "p12_positions",
    f"""WITH {PRODUCTS_SQL},
        numbered AS (SELECT nm, title, row_number() OVER (ORDER BY nm) - 1 AS old_index
                     FROM products)
        SELECT nm, title, old_index, row_number() OVER (ORDER BY nm) - 1 AS row_id
        FROM numbered WHERE title IS NOT NULL""",
)
def p12(spark, sf):
    numbered = N.with_positions(products(spark, sf).select("nm", "title"), ["nm"])
    return N.renumber(P.drop_null(numbered, "title"), ["nm"])


@query("p13_required_columns", "SELECT doc_id, quality AS target FROM labels")
def p13(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("target"))
    return P.require_columns(rows, "doc_id", "target")


@query(
    "p14_keep_finite",
    "SELECT vec_id FROM embeddings WHERE label NOT IN (0, 1)",
)
def p14(spark, sf):
    odd = (
        F.when(F.col("label") == 0, F.lit(float("nan")))
        .when(F.col("label") == 1, F.lit(float("-inf")))
        .otherwise(F.lit(0.0))
        .cast("float")
    )
    rows = table(spark, sf, "embeddings").withColumn("vec", F.array_append("embedding", odd))
    return P.keep_finite(rows, ["embedding", "vec"], on_bad="drop").select("vec_id")


@query("p15_bool_to_int", "SELECT doc_id, (n_chars > 3000)::INT AS flag FROM documents")
def p15(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", P.bool_to_int(F.col("n_chars") > 3000).alias("flag"))


@query(
    "p16_keep_members",
    "SELECT p_partkey, p_type FROM part WHERE p_type IN ('SMALL', 'LARGE', 'PROMO')",
)
def p16(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    return P.keep_members(part, "p_type", ["SMALL", "LARGE", "PROMO"])


SHUFFLE_KEY_SQL = "('0x' || substr(md5('42|' || {key}::VARCHAR), 1, 15))::BIGINT"
DOC_KEY_SQL = SHUFFLE_KEY_SQL.format(key="doc_id")


@query(
    "p17_p19_shuffled_batches",
    f"""WITH numbered AS (
          SELECT doc_id, row_number() OVER (ORDER BY {DOC_KEY_SQL}, doc_id) - 1 AS row_id
          FROM documents)
        SELECT doc_id, row_id, row_id // 16 AS batch_id FROM numbered""",
)
def p17(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return N.shuffled(docs, "doc_id").withColumn("batch_id", N.batch_of(16))


@query("p18_head", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 8")
def p18(spark, sf):
    return N.head(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], 8)


@query(
    "p18_random_rows",
    f"SELECT doc_id, text FROM documents ORDER BY {DOC_KEY_SQL}, doc_id LIMIT 100",
)
def p18_random(spark, sf):
    return N.random_rows(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", 100)


@query(
    "p19_batches",
    """WITH numbered AS (
         SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS row_id FROM part)
       SELECT p_partkey, row_id // 10 AS batch_id FROM numbered""",
)
def p19(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    numbered = N.with_positions(part, ["p_name", "p_partkey"])
    return numbered.select("p_partkey", N.batch_of(10).alias("batch_id"))


@query(
    "j5_append",
    "SELECT text FROM documents UNION ALL SELECT text FROM benchmark",
)
def j5(spark, sf):
    return append(
        table(spark, sf, "documents").select("text"), table(spark, sf, "benchmark").select("text")
    )


@query(
    "p12_appended_positions",
    "SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS row_id FROM documents",
)
def p12_appended(spark, sf):
    """Positions after three appends to a stored table; only ranges with new rows are written anew."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    store = PositionStore(spark, fresh_path(spark, "positions"), "doc_id", range_rows=max(50, docs.count() // 16))
    store.create(docs.where("doc_id % 10 < 7"))
    for part in ("doc_id % 10 = 7", "doc_id % 10 = 8 AND doc_id % 3 = 0", "doc_id % 10 = 9 OR (doc_id % 10 = 8 AND doc_id % 3 <> 0)"):
        store.append(docs.where(part))
    return store.positions()
