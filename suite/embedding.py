"""Encoding, similarity and image resizing."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfvec.operators.encode import encode, onnx_factory, vector_report
from shelfvec.operators.identical import identical_products
from shelfvec.operators.resize import complete_images, resize_images
from shelfvec.operators.similarity import (
    batch_logits,
    concat_vectors,
    contrastive_loss,
    l2_normalize,
)
from shelfvec.plans.embedding import embed_rows
from shelfvec.sources.image_files import decode_images, read_listed_files
from shelfvec.sources.scratch import fresh_path
from shelfvec.sources.shipping import ensure_shipped
from suite import query, table
from suite.onnx_model import matmul_model
from suite.views import PIXELS_SQL, pictures, vectors


def plain_encoder():
    """Counts of text characters and sums of picture rows: vectors SQL can check."""
    import numpy as np

    class Plain:
        def text(self, values):
            return np.array([[len(v), v.count("e"), v.count(" ")] for v in values], dtype=float)

        def image(self, values):
            return np.array([v[:, :, 0].sum(axis=1) for v in values], dtype=float)

    return Plain()


@query(
    "e1_encode",
    f"""WITH {PIXELS_SQL},
        sums AS (SELECT nm, y, sum(v) AS s FROM pixels GROUP BY nm, y)
        SELECT doc_id AS row_id, length(text)::DOUBLE AS n_chars,
               (length(text) - length(replace(text, 'e', '')))::DOUBLE AS n_e,
               (length(text) - length(replace(text, ' ', '')))::DOUBLE AS n_spaces,
               {", ".join(f"coalesce(max(s) FILTER (y = {y}), 0)::DOUBLE AS row_{y}" for y in range(8))}
        FROM documents LEFT JOIN sums ON doc_id = nm GROUP BY doc_id, text""",
)
def e1(spark, sf):
    """All documents; those without a picture get the black one."""
    ensure_shipped(spark, "suite")
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("doc_id").alias("nm"), "text"
    )
    coded = embed_rows(docs, pictures(spark, sf), plain_encoder, 32, (8, 8), "text", "double")
    text, img = F.col("text"), F.col("img")
    return coded.select(
        "row_id",
        text[0].alias("n_chars"),
        text[1].alias("n_e"),
        text[2].alias("n_spaces"),
        *[img[y].alias(f"row_{y}") for y in range(8)],
    )


def _projection_sql(first, component):
    weight = f"(((i * 7 + {component} * 3) % 11) - 5) / 10.0::DOUBLE"
    terms = f"list_transform(range(32), lambda i: embedding[i + {first}]::DOUBLE * ({weight}))"
    return f"round(list_sum({terms}), 6) + 0.0"


@query(
    "e2_onnx_scores",
    "SELECT vec_id AS row_id, "
    + ", ".join(f"{_projection_sql(1, i)} AS text_{i}, {_projection_sql(33, i)} AS img_{i}" for i in range(8))
    + " FROM embeddings",
)
def e2(spark, sf):
    model = matmul_model(32, 8)
    scored = encode(
        vectors(spark, sf),
        onnx_factory(spark, model, model),
        text="text",
        image="img",
        batch_size=64,
        element="double",
    )
    return scored.select(
        "row_id",
        *[
            (F.round(F.col(side)[i], 6) + 0.0).alias(f"{side}_{i}")
            for side in ("text", "img")
            for i in range(8)
        ],
    )


@query(
    "e3_concat",
    "SELECT vec_id AS row_id, i AS place, embedding[i + 1] AS value FROM embeddings, unnest(range(64)) r(i)",
)
def e3(spark, sf):
    rows = vectors(spark, sf)
    exploded = rows.select("row_id", F.posexplode(concat_vectors()).alias("place", "value"))
    return exploded.withColumn("place", F.col("place").cast("long"))


@query(
    "e4_l2_normalize",
    """WITH n AS (SELECT vec_id, embedding,
                         sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm
                  FROM embeddings)
       SELECT vec_id, i AS place, round(embedding[i + 1]::DOUBLE / norm, 6) + 0.0 AS value
       FROM n, unnest(range(64)) r(i)""",
)
def e4(spark, sf):
    rows = table(spark, sf, "embeddings")
    unit = rows.select("vec_id", F.posexplode(l2_normalize("embedding")).alias("place", "value"))
    return unit.select(
        "vec_id", F.col("place").cast("long").alias("place"), (F.round("value", 6) + 0.0).alias("value")
    )


PAIRS_SQL = """
unit AS (SELECT vec_id AS row_id, vec_id // 32 AS batch_id,
                list_transform(embedding[1:32], lambda x: x::DOUBLE) AS text,
                list_transform(embedding[33:64], lambda x: x::DOUBLE) AS img FROM embeddings),
pairs AS (SELECT i.batch_id, i.row_id AS image_id, t.row_id AS text_id,
                 exp(1.0::DOUBLE) * list_dot_product(i.img, t.text)
                 / sqrt(list_dot_product(i.img, i.img) * list_dot_product(t.text, t.text)) AS logit
          FROM unit i JOIN unit t USING (batch_id))
"""


@query(
    "e5_batch_logits",
    f"""WITH {PAIRS_SQL},
        by_image AS (SELECT batch_id, image_id AS row_id, max(logit) AS best_image,
                            sum(logit) AS sum_image,
                            max(CASE WHEN text_id = image_id THEN logit END) AS own
                     FROM pairs GROUP BY ALL),
        by_text AS (SELECT text_id AS row_id, max(logit) AS best_text, sum(logit) AS sum_text,
                           count(*) AS width
                    FROM pairs GROUP BY ALL)
        SELECT batch_id, row_id, width::INT AS width, round(own, 6) + 0.0 AS own,
               round(best_image, 6) + 0.0 AS best_image, round(sum_image, 6) + 0.0 AS sum_image,
               round(best_text, 6) + 0.0 AS best_text, round(sum_text, 6) + 0.0 AS sum_text
        FROM by_image JOIN by_text USING (row_id)""",
)
def e5(spark, sf):
    logits = batch_logits(vectors(spark, sf), 32)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    own = F.element_at("logits_per_image", (F.col("row_id") % 32 + 1).cast("int"))
    values = {
        "own": own,
        "best_image": F.array_max("logits_per_image"),
        "sum_image": total("logits_per_image"),
        "best_text": F.array_max("logits_per_text"),
        "sum_text": total("logits_per_text"),
    }
    return logits.select(
        "batch_id",
        "row_id",
        F.size("logits_per_text").alias("width"),
        *[(F.round(value, 6) + 0.0).alias(name) for name, value in values.items()],
    )


@query(
    "e6_contrastive_loss",
    f"""WITH {PAIRS_SQL},
        rows_ AS (SELECT batch_id, image_id, ln(sum(exp(logit)))
                         - max(CASE WHEN text_id = image_id THEN logit END) AS loss
                  FROM pairs GROUP BY batch_id, image_id),
        cols_ AS (SELECT batch_id, text_id, ln(sum(exp(logit)))
                         - max(CASE WHEN text_id = image_id THEN logit END) AS loss
                  FROM pairs GROUP BY batch_id, text_id),
        a AS (SELECT batch_id, count(*) AS n, avg(loss) AS image_loss FROM rows_ GROUP BY batch_id),
        b AS (SELECT batch_id, avg(loss) AS text_loss FROM cols_ GROUP BY batch_id)
        SELECT batch_id, n, round(image_loss, 6) AS image_loss, round(text_loss, 6) AS text_loss,
               round((image_loss + text_loss) / 2, 6) AS loss
        FROM a JOIN b USING (batch_id)""",
)
def e6(spark, sf):
    loss = contrastive_loss(vectors(spark, sf), 32)
    return loss.select(
        "batch_id", "n", *[F.round(c, 6).alias(c) for c in ("image_loss", "text_loss", "loss")]
    )


def _shares_sql(name, size_out, size_in=8):
    """Units of each input cell in each output cell."""
    return f"""
      {name} AS (
        SELECT o, i, greatest(0, least((o + 1) * {size_in}, (i + 1) * {size_out})
                                 - greatest(o * {size_in}, i * {size_out})) AS w
        FROM unnest(range({size_out})) a(o), unnest(range({size_in})) b(i))"""


def _resized_sql(width, height):
    """Area means of 8 x 8 pictures, halves rounded up."""
    return f"""
      {PIXELS_SQL}, {_shares_sql("wx", width)}, {_shares_sql("wy", height)},
      means AS (SELECT nm, wy.o AS y, wx.o AS x, (sum(v * wx.w * wy.w)::BIGINT + 32) // 64 AS v
                FROM pixels JOIN wx ON x = wx.i JOIN wy ON y = wy.i GROUP BY nm, wy.o, wx.o),
      resized AS (SELECT nm, string_agg(printf('%02X%02X%02X', v, v, v), '' ORDER BY y, x) AS rgb
                  FROM means GROUP BY nm)"""


@query(
    "e7_shrink_images",
    f"""WITH {_resized_sql(4, 4)}
        SELECT doc_id AS nm, 4 AS width, 4 AS height, rgb IS NULL AS missing,
               coalesce(rgb, repeat('000000', 16)) AS rgb
        FROM documents LEFT JOIN resized ON nm = doc_id""",
)
def e7(spark, sf):
    manifest = table(spark, sf, "documents").select(F.col("doc_id").alias("nm"))
    whole = complete_images(manifest, resize_images(pictures(spark, sf), (4, 4)), (4, 4))
    return whole.select("nm", "width", "height", "missing", F.hex("data").alias("rgb"))


@query(
    "e8_exact_resize",
    f"WITH {_resized_sql(5, 3)} SELECT nm, 5 AS width, 3 AS height, rgb FROM resized",
)
def e8(spark, sf):
    resized = resize_images(pictures(spark, sf), (5, 3), exact=True)
    return resized.select("nm", "width", "height", F.hex("data").alias("rgb"))


@query(
    "e9_vector_report",
    """SELECT count(*) AS n_rows, min(len(embedding[1:32]))::INT AS text_min,
              max(len(embedding[1:32]))::INT AS text_max, min(len(embedding[33:64]))::INT AS img_min,
              max(len(embedding[33:64]))::INT AS img_max
       FROM embeddings""",
)
def e9(spark, sf):
    return vector_report(vectors(spark, sf))


# Listings of one product: every fifth vector again with other components, some of them twice over.
LISTINGS_SQL = """
listings AS (
  SELECT vec_id AS row_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  UNION ALL
  SELECT vec_id + 10000000, list_transform(embedding, lambda x, i: x::DOUBLE * (1 + 0.15 * ((i * 7 + vec_id) % 5 - 2)))
  FROM embeddings WHERE vec_id % 5 = 0
  UNION ALL
  SELECT vec_id + 20000000, list_transform(embedding, lambda x, i: x::DOUBLE * power(1 + 0.15 * ((i * 7 + vec_id) % 5 - 2), 2))
  FROM embeddings WHERE vec_id % 10 = 0
  UNION ALL
  SELECT vec_id + 30000000, list_transform(embedding, lambda x: x::DOUBLE * 4) FROM embeddings WHERE vec_id % 20 = 0)
"""


def _listings(spark, sf):
    base = table(spark, sf, "embeddings")
    vec = F.transform("embedding", lambda x: x.cast("double"))
    factor = lambda i: 1 + 0.15 * (((i + 1) * 7 + F.col("vec_id")) % 5 - 2)
    parts = [
        base.select(F.col("vec_id").alias("row_id"), vec.alias("vector")),
        base.where("vec_id % 5 = 0").select(F.col("vec_id") + 10000000, F.transform(vec, lambda x, i: x * factor(i))),
        base.where("vec_id % 10 = 0").select(F.col("vec_id") + 20000000, F.transform(vec, lambda x, i: x * factor(i) * factor(i))),
        base.where("vec_id % 20 = 0").select(F.col("vec_id") + 30000000, F.transform(vec, lambda x: x * 4)),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


@query(
    "e4_identical_products",
    f"""WITH RECURSIVE {LISTINGS_SQL},
        pairs AS MATERIALIZED (
          SELECT a.row_id AS u, b.row_id AS v FROM listings a JOIN listings b ON a.row_id <> b.row_id
          WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
        reach AS (SELECT row_id AS u, row_id AS v FROM listings
                  UNION SELECT r.u, p.v FROM reach r JOIN pairs p ON r.v = p.u)
        SELECT u AS row_id, min(v) AS product_id, (SELECT count(*) FROM pairs p WHERE p.u = reach.u) AS n_links
        FROM reach GROUP BY u""",
)
def e4_identical(spark, sf):
    """Groups of listings whose cosine is 0.95 or more, the twin by all pairs."""
    return identical_products(_listings(spark, sf), 0.95, recall=0.999999)


def write_png(path, height, width, data):
    """A grey PNG file, every line under another filter."""
    import struct
    import zlib

    from pyarrow import fs

    lines = b""
    for y in range(height):
        row = data[y * width : (y + 1) * width]
        above = data[(y - 1) * width : y * width] if y else bytes(width)
        before = b"\0" + row[:-1]
        guess = (bytes(width), before, above)[y % 3]
        lines += bytes([y % 3]) + bytes((a - b) & 255 for a, b in zip(row, guess, strict=True))

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    content = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    system, place = fs.FileSystem.from_uri(path)
    system.create_dir(place.rsplit("/", 1)[0])
    with system.open_output_stream(place) as file:
        file.write(content)


@query(
    "s7_listed_images",
    f"""WITH {PIXELS_SQL}
        SELECT vec_id AS nm, vec_id % 9 = 4 AS missing,
               CASE WHEN vec_id % 9 = 4 THEN -1 ELSE 8 END AS height, CASE WHEN vec_id % 9 = 4 THEN -1 ELSE 8 END AS width,
               CASE WHEN vec_id % 9 = 4 THEN '' ELSE (SELECT upper(string_agg(lpad(printf('%x', v), 2, '0'), '' ORDER BY y, x)) FROM pixels p WHERE p.nm = vec_id) END AS pixels
        FROM embeddings""",
)
def s7(spark, sf):
    """Pictures written to files by their tasks, a ninth of them left out, and read by a list of paths."""
    ensure_shipped(spark)
    ensure_shipped(spark, "suite")
    folder = fresh_path(spark, "pictures").replace("file:/", "file:///", 1).replace("file://///", "file:///", 1)
    path = F.concat(F.lit(folder + "/"), F.col("nm") % 7, F.lit("/"), "nm", F.lit(".png")).alias("image_path")
    given = pictures(spark, sf).select("nm", path, "image.height", "image.width", "image.data")

    def written(batches):
        for batch in batches:
            for row in batch.to_pylist():
                write_png(row["image_path"], row["height"], row["width"], row["data"])
            yield batch.select(["nm"])

    given.where("nm % 9 <> 4").mapInArrow(written, "nm long").count()
    images = decode_images(read_listed_files(given, slice_files=300))
    return images.select("nm", "missing", "image.height", "image.width", F.hex("image.data").alias("pixels"))
