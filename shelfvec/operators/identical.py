"""Identical products: groups of vectors whose cosine reaches a threshold.

Vectors meet in buckets of random projections: the signs of a few random dot
products. Two unit vectors at an angle t agree on one sign with probability
1 - t / pi, so the number of tables follows from the wanted chance of a pair
right at the threshold; closer pairs are surer. Whatever meets is verified by
its cosine, so no wrong pair comes out. A hot bucket is cut into cells of two
chunks each, in which every pair of it still meets. Equal vectors go in once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfvec.operators.components import components
from shelfvec.sources.scratch import materialize
from shelfvec.sources.shipping import ensure_shipped

# Signs of a bucket, wanted chance of a pair at the threshold, vectors of a chunk.
BITS = 12
RECALL = 0.999
CHUNK = 1024
# Bytes of bucket rows that a task holds at once.
PIECE_BYTES = 4 * 1024 * 1024

LINK = T.StructType([T.StructField(n, T.LongType()) for n in ("u", "v")])


def table_count(threshold: float, bits: int = BITS, recall: float = RECALL) -> int:
    """Tables after which a pair at the threshold has met with the wanted chance."""
    meets = (1 - math.acos(min(threshold, 1.0)) / math.pi) ** bits
    return 1 if meets >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - meets)))


def bucket_rows(batch: pa.RecordBatch, planes: np.ndarray, bits: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """A row per vector and table, in pieces: all of a batch would be as many copies of it as there are tables."""
    width, tables = len(planes), planes.shape[1] // bits
    powers = 1 << np.arange(bits, dtype="int64")
    size = max(1, PIECE_BYTES // (tables * (8 * width + 24)))
    for first in range(0, batch.num_rows, size):
        part = batch.slice(first, size)
        n = part.num_rows
        x = part.column("unit").flatten().to_numpy().reshape(n, width)
        signs = (x @ planes > 0).reshape(n, tables, bits)
        numbers = signs @ powers + (np.arange(tables, dtype="int64") << bits)
        owner = pa.array(np.repeat(np.arange(n), tables))
        yield pa.RecordBatch.from_arrays([*[part.column(c).take(owner) for c in ("node", "unit")], pa.array(numbers.ravel())], names=names)


def buckets(units: DataFrame, width: int, bits: int, tables: int, seed: int) -> DataFrame:
    """``node, unit, bucket`` rows, one per table; a bucket's number holds its table."""
    ensure_shipped(units.sparkSession)
    schema = T.StructType([*units.schema.fields, T.StructField("bucket", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).normal(size=(width, tables * bits))
        for batch in batches:
            yield from bucket_rows(batch, planes, bits, schema.names)

    return units.select("node", "unit").mapInArrow(run, schema)


def _cells(keyed: DataFrame, chunk: int) -> DataFrame:
    """Rows of each bucket of two or more, in the cells where they meet the others."""
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / chunk)
    own = F.pmod(F.xxhash64("node"), F.col("chunks"))
    return (
        keyed.join(materialize(sizes, "bucket-sizes"), "bucket")
        .withColumn("chunks", chunks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "unit")
    )


def similar_pairs(units: DataFrame, width: int, threshold: float, bits: int, tables: int, chunk: int, seed: int) -> DataFrame:
    """``u, v``: pairs of nodes, the smaller first, whose unit vectors' product reaches the threshold."""
    keyed = materialize(buckets(units, width, bits, tables, seed), "buckets")
    order = ["bucket", "low", "high"]

    def close(nodes: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        us, vs = [], []
        for first in range(0, len(x), 512):
            a, b = np.nonzero(x[first : first + 512] @ x.T >= threshold)
            a = a + first
            keep = nodes[a] < nodes[b]
            us.append(nodes[a[keep]])
            vs.append(nodes[b[keep]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in (us, vs)], names=LINK.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, nodes, parts = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in order]
            node = batch.column("node").to_numpy()
            x = batch.column("unit").flatten().to_numpy().reshape(batch.num_rows, width)
            new = np.zeros(batch.num_rows, dtype=bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(int(k[a]) for k in keys)
                if key != open_key:
                    if parts:
                        yield close(np.concatenate(nodes), np.concatenate(parts))
                    open_key, nodes, parts = key, [], []
                nodes.append(node[a:b])
                parts.append(x[a:b])
        if parts:
            yield close(np.concatenate(nodes), np.concatenate(parts))

    cells = _cells(keyed, chunk).repartition(*order).sortWithinPartitions(*order)
    return cells.mapInArrow(run, LINK).distinct()


def identical_products(
    vectors: DataFrame,
    threshold: float = 0.95,
    key: str = "row_id",
    column: str = "vector",
    bits: int = BITS,
    recall: float = RECALL,
    tables: int | None = None,
    chunk: int = CHUNK,
    seed: int = 42,
) -> DataFrame:
    """``row_id, product_id, n_links``: the smallest key reachable over links, and the row's own links.

    Two rows are linked if the cosine of their vectors is at least
    ``threshold``. A pair is found with a chance of ``recall`` or more; as many
    ``tables`` are made as that takes. ``n_links`` counts linked other rows.

    A null vector, and one of length zero, is linked with nothing, not even its
    copies. Vectors have one width; keys are unique. An empty table gives an
    empty table.
    """
    square = F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    norm = F.sqrt(square)
    given = vectors.select(F.col(key).cast("long").alias("row_id"), F.col(column).alias("v"), norm.alias("norm"))
    unit = F.transform("v", lambda x: x.cast("double") / F.col("norm"))
    given = given.select("row_id", F.when(F.col("norm") > 0, unit).alias("unit"))
    given = materialize(given.withColumn("digest", F.when(F.col("unit").isNotNull(), F.sha2(F.to_json(F.struct("unit")), 256))), "unit-vectors")
    known = given.where("unit IS NOT NULL")
    first = known.select("unit").first()
    alone = given.select("row_id", F.col("row_id").alias("product_id"), F.lit(0).cast("long").alias("n_links"))
    if first is None:
        return alone
    width = len(first["unit"])
    # Exact copies stand for each other, so a product listed a million times is one node.
    copies = known.groupBy("digest").agg(F.min("row_id").alias("node"), F.count("*").alias("n"), F.first("unit").alias("unit"))
    nodes = materialize(copies, "distinct-vectors")
    count = tables or table_count(threshold, bits, recall)
    links = materialize(similar_pairs(nodes.select("node", "unit"), width, threshold, bits, count, chunk, seed), "links")
    both = links.union(links.select("v", "u"))
    degrees = (
        both.join(nodes.select(F.col("node").alias("v"), "n"), "v").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("others"))
    )
    roots = components(links)
    named = nodes.select("digest", "node", "n").join(roots, "node", "left").join(degrees, "node", "left")
    named = named.select(
        "digest",
        F.coalesce("root", "node").alias("product_id"),
        (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
    )
    found = known.select("row_id", "digest").join(named, "digest").select("row_id", "product_id", "n_links")
    return found.unionByName(alone.join(known.select("row_id"), "row_id", "left_anti"))
