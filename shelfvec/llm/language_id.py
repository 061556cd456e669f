"""Language of texts by the nearest of several centroids per language.

A text is a vector of its letter bigrams and trigrams, hashed to ``DIMENSIONS``
places, weighted by (1 + log tf) * idf and scaled to length one. Document
frequencies come from all training texts. The vectors of a bounded sample of
each language, ``sample`` texts at most, are clustered by cosine into
``clusters`` centroids. A text gets the language of the nearest centroid; it is
marked as rejected where that centroid is farther than nearly all of its own
training texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfvec.sources.scratch import materialize
from shelfvec.sources.shipping import ensure_shipped

DIMENSIONS = 4096
CHUNK = 1 << 20
MAX_LANGUAGES = 2_000
UNKNOWN = "und"

_letters: list[np.ndarray] = []


@dataclass(frozen=True)
class Training:
    sample: int = 500
    clusters: int = 4
    rounds: int = 12
    #: Share of a centroid's training texts that lie beyond its radius.
    beyond: float = 0.005


def letters() -> np.ndarray:
    """Which code points are letters; made once per process."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def gram_counts(text: str | None) -> np.ndarray | None:
    """Hashed counts of bigrams and trigrams over letters and word ends; None without letters."""
    if not text:
        return None
    counts = np.zeros(DIMENSIONS, dtype="int64")
    for first in range(0, len(text), CHUNK):
        # Two characters before the chunk, so that no gram is lost between chunks.
        part = " " + text[first : first + CHUNK] + " " if not first else text[first - 2 : first + CHUNK] + " "
        points = np.frombuffer(part.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        points = np.where(letters()[points], points, 32)
        blank = points == 32
        points = points[np.concatenate([[True], ~(blank[1:] & blank[:-1])])].astype("<u4")
        if len(points) < 2:
            continue
        pairs = points[:-1] * np.uint32(0x9E3779B1) + points[1:] * np.uint32(0x85EBCA6B)
        counts += np.bincount((pairs ^ (pairs >> np.uint32(15))) % DIMENSIONS, minlength=DIMENSIONS)
        triples = pairs[:-1] * np.uint32(0xC2B2AE35) + points[2:] * np.uint32(0x27D4EB2F)
        counts += np.bincount((triples ^ (triples >> np.uint32(15))) % DIMENSIONS, minlength=DIMENSIONS)
    return counts if counts.any() else None


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The normalised vector of a text's counts."""
    weights = np.zeros(DIMENSIONS, dtype="f4")
    at = counts.nonzero()[0]
    weights[at] = (1 + np.log(counts[at])) * idf[at]
    return weights / np.linalg.norm(weights)


def held_out(doc_id: Column, modulus: int = 4, remainder: int = 2) -> Column:
    """Whether the CRC-32 of the id as text leaves a remainder; never for a null id."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(crc % modulus == remainder, F.lit(False))


def gram_idf(train: DataFrame) -> np.ndarray:
    """Inverse document frequencies over all rows of ``text``."""
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("df", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(DIMENSIONS, dtype="int64")
        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts = gram_counts(text)
                if counts is not None:
                    n += 1
                    df += counts > 0
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([df.tolist()], pa.list_(pa.int64()))], names=["n", "df"])

    parts = materialize(train.select("text").mapInArrow(run, schema), "gram-counts")
    n = parts.agg(F.sum("n")).first()[0] or 0
    df = np.zeros(DIMENSIONS)
    sums = parts.select(F.posexplode("df").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
    for row in sums.collect():  # DIMENSIONS rows, whatever the input
        df[row["at"]] = row["n"]
    return (np.log((1 + n) / (1 + df)) + 1).astype("f4")


def centroids_of(vectors: np.ndarray, rule: Training) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart starts; centroids and their radii as cosines."""
    chosen = [vectors.mean(axis=0)]
    chosen[0] = chosen[0] / (np.linalg.norm(chosen[0]) or 1)
    nearest = vectors @ chosen[0]
    while len(chosen) < min(rule.clusters, len(vectors)):
        far = vectors[int(nearest.argmin())]
        chosen.append(far)
        nearest = np.maximum(nearest, vectors @ far)
    centers = np.array(chosen)
    for _ in range(rule.rounds):
        own = (vectors @ centers.T).argmax(axis=1)
        new = centers.copy()
        for k in range(len(centers)):
            if (own == k).any():
                mean = vectors[own == k].mean(axis=0)
                new[k] = mean / (np.linalg.norm(mean) or 1)
        if np.allclose(new, centers):
            break
        centers = new
    close = vectors @ centers.T
    own, best = close.argmax(axis=1), close.max(axis=1)
    radii = [np.quantile(best[own == k], rule.beyond) if (own == k).any() else 1.0 for k in range(len(centers))]
    return centers, np.array(radii)


def language_centroids(train: DataFrame, idf: np.ndarray, rule: Training) -> DataFrame:
    """``lang, center, radius`` from a bounded sample of ``doc_id, text, lang``."""
    order = F.xxhash64(F.col("doc_id"))
    sizes = train.groupBy("lang").agg(F.count("*").alias("n")).withColumnRenamed("lang", "_lang")
    # About twice the sample by rate first, so that no language meets in one task whole.
    place = F.pmod(order, F.lit(1 << 30)) / float(1 << 30)
    likely = (
        train.select("doc_id", "lang")
        .join(F.broadcast(sizes) if _few(sizes) else sizes, F.col("lang") == F.col("_lang"))
        .where(place * F.col("n") <= 2 * rule.sample + 50)
    )
    ranked = likely.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id")))
    ids = ranked.where(F.col("k") <= rule.sample).select(F.col("doc_id").alias("_id")).distinct()
    # Stored, so that its size is known and the texts need not be shuffled for it.
    ids = materialize(ids, "sample")
    sample = train.join(ids, F.col("doc_id") == F.col("_id"), "left_semi").select("lang", "text")
    schema = T.StructType(
        [
            T.StructField("lang", T.StringType()),
            T.StructField("center", T.ArrayType(T.FloatType())),
            T.StructField("radius", T.DoubleType()),
        ]
    )

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        counts = [c for c in map(gram_counts, sorted(rows["text"])) if c is not None]
        if not counts:
            return pd.DataFrame({"lang": [], "center": [], "radius": []})
        centers, radii = centroids_of(np.array([unit(c, idf) for c in counts]), rule)
        return pd.DataFrame(
            {"lang": rows["lang"].iloc[0], "center": [c.astype("f4").tolist() for c in centers], "radius": radii}
        )

    return sample.groupBy("lang").applyInPandas(fit, schema)


def _few(sizes: DataFrame) -> bool:
    """Whether the languages are few enough to be sent to all tasks; beyond it is refused."""
    if sizes.limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    return True


def predict_languages(
    docs: DataFrame, train: DataFrame, text_col: str = "text", rule: Training | None = None
) -> DataFrame:
    """Add ``lang_pred``, ``score`` (cosine with the nearest centroid, 0 to 1) and ``rejected``.

    ``train`` has ``doc_id, text, lang``; rows with a null text or language teach
    nothing. A null text, or one without letters, is ``und`` with score 0 and
    rejected; so is every text if nothing could be learned. Only the text is an
    input of the prediction. ``text_col`` is left out of the result, and columns
    named like the new ones are replaced. An empty table gives an empty table.
    """
    spark, rule = docs.sparkSession, rule or Training()
    ensure_shipped(spark)
    train = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    idf = gram_idf(train)
    centers = language_centroids(train, idf, rule).orderBy("lang", "radius").collect()
    langs = [r["lang"] for r in centers]
    matrix = np.array([r["center"] for r in centers], dtype="f4").reshape(-1, DIMENSIONS)
    sent = spark.sparkContext.broadcast((langs, matrix, np.array([r["radius"] for r in centers]), idf))
    new = {"lang_pred": T.StringType(), "score": T.DoubleType(), "rejected": T.BooleanType()}
    rest = [f for f in docs.schema.fields if f.name not in {*new, text_col}]
    kept = [f.name for f in rest]
    schema = T.StructType([*rest, *(T.StructField(n, t, False) for n, t in new.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix, radii, idf = sent.value
        for batch in batches:
            size = batch.num_rows
            found, scores, far = [UNKNOWN] * size, np.zeros(size), np.ones(size, dtype=bool)
            texts = batch.column(text_col).to_pylist()
            for first in range(0, size, 256):
                at, vectors = [], []
                for i in range(first, min(first + 256, size)):
                    counts = gram_counts(texts[i])
                    if counts is not None:
                        at.append(i)
                        vectors.append(unit(counts, idf))
                if not at or not names:
                    continue
                close = np.array(vectors) @ matrix.T
                best = close.argmax(axis=1)
                for i, k, x in zip(at, best, close.max(axis=1), strict=True):
                    found[i], scores[i], far[i] = names[k], min(1.0, max(0.0, float(x))), x < radii[k]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in kept] + [pa.array(found, pa.string()), pa.array(scores), pa.array(far)],
                names=[*kept, *new],
            )

    return docs.mapInArrow(run, schema)


def held_out_languages(docs: DataFrame) -> DataFrame:
    """Predictions for all documents, learned from those that are not held out."""
    rows = docs.select("doc_id", "text", "lang")
    train = rows.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict_languages(marked, train).select("doc_id", "held_out", "lang_pred", "score", "rejected")
