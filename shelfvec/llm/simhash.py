"""Near copies by SimHash fingerprints and a Gray-order hierarchical index.

Fingerprints at most ``max_bits`` apart agree on one of ``max_bits + 1`` blocks,
so each distinct fingerprint goes to the group of each of its blocks. A group
is searched with an index: its fingerprints are sorted by their rank in the
Gray code, which puts those with common leading bits next to each other. Bits
on which neighbours agree are factored into a node above them, again level by
level up to one root. All queries go down the levels together; each adds the
bits in which it differs from a node's own pattern and drops the whole node
once they are too many.

Large groups are cut into cells of two chunks each, so that every pair of
fingerprints still meets. A group answers with links that join the same
fingerprints as all its pairs would, one fewer than fingerprints at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfvec.llm.words import ascii_lower, words_of
from shelfvec.operators.components import components
from shelfvec.sources.scratch import materialize
from shelfvec.sources.shipping import ensure_shipped

SEED = 42
FANOUT = 8


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Rows of eight bytes: big-endian XXH64 of each shingle, repeats included."""
    import xxhash

    words = words_of(ascii_lower(text)) if text else []
    if not words:
        return np.empty((0, 8), dtype="u1")
    joined = " ".join(words).encode()
    gaps = np.flatnonzero(np.frombuffer(joined, dtype="u1") == 32)
    width = min(shingle, len(words))
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)][width - 1 :]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=False)])
    return np.frombuffer(hashes, dtype="u1").reshape(-1, 8)


def majority_bits(rows: np.ndarray) -> int:
    """Bits set in over half the hashes; zero without any."""
    counts = sum(
        np.unpackbits(rows[i : i + 65_536], axis=1).sum(axis=0, dtype="int64")
        for i in range(0, len(rows), 65_536)
    )
    return int.from_bytes(np.packbits(2 * counts > len(rows)).tobytes(), "big") if len(rows) else 0


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bits set in over half the XXH64 of a text's shingles, repeats included."""
    return majority_bits(shingle_hashes(text, shingle))


def prefix_of(values: np.ndarray, similarity: float, last: np.ndarray | None = None) -> np.ndarray:
    """So many of the sorted distinct hashes that sets with that Jaccard similarity share one.

    Such sets have at least ``ceil(similarity * n)`` of each one's n hashes in
    common, so the first common one is among the first ``n - ceil(..) + 1`` in
    any order that is the same for all sets. Hashes in the sorted ``last`` come
    after all others.
    """
    most = len(values) - int(np.ceil(similarity * len(values) - 1e-9)) + 1 if len(values) else 0
    if last is not None and len(last):
        at = np.minimum(np.searchsorted(last, values), len(last) - 1)
        late = last[at] == values
        values = np.concatenate([values[~late], values[late]])
    return values[:most]


def fingerprints(
    docs: DataFrame, text_col: str = "text", shingle: int = 3, drop_text: bool = False, similarity: float = 0
) -> DataFrame:
    """Add ``fp`` (the 64 bits as a signed long) and ``row`` (a number of the row).

    With ``similarity`` the column ``keys`` holds the hashes of ``prefix_of``, and
    ``size`` the number of distinct shingles.
    """
    ensure_shipped(docs.sparkSession)
    new = ["fp", "row", *(["keys", "size"] if similarity else [])]
    rest = [f for f in docs.schema.fields if f.name not in {*new, *([text_col] if drop_text else [])}]
    kept = [f.name for f in rest]
    schema = T.StructType([*rest, T.StructField("fp", T.LongType()), T.StructField("row", T.LongType())])
    if similarity:
        schema = schema.add(T.StructField("keys", T.ArrayType(T.LongType()))).add(T.StructField("size", T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            bits, keys, sizes = [], [], []
            for text in batch.column(text_col).to_pylist():
                hashes = shingle_hashes(text, shingle)
                bits.append(majority_bits(hashes))
                if similarity:
                    values = distinct_hashes(hashes)
                    sizes.append(len(values))
                    keys.append(prefix_of(values, similarity).view("i8"))
            rows = np.arange(number, number + len(bits))
            number += len(bits)
            columns = [batch.column(n) for n in kept]
            columns += [pa.array(np.array(bits, dtype="u8").view("i8")), pa.array(rows)]
            if similarity:
                columns += [pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])

    return docs.mapInArrow(run, schema)


def distinct_hashes(rows: np.ndarray) -> np.ndarray:
    """The distinct hashes in order, as unsigned longs."""
    return np.unique(rows.reshape(-1).view(">u8")).astype("u8")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each 64-bit pattern in the Gray code's order."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of (pattern, mask) nodes; a node's children are FANOUT neighbours below."""

    def __init__(self, values: np.ndarray):
        self.values = values[np.argsort(gray_rank(values), kind="stable")]
        patterns = self.values
        masks = np.full(len(patterns), ~np.uint64(0))
        levels = [(patterns, masks)]
        while len(patterns) > 1:
            starts = np.arange(0, len(patterns), FANOUT)
            ones = np.bitwise_and.reduceat(patterns, starts)
            zeros = np.bitwise_and.reduceat(~patterns, starts)
            masks = np.bitwise_and.reduceat(masks, starts) & (ones | zeros)
            patterns = ones & masks
            levels.append((patterns, masks))
        # A node keeps only the bits that its parent has not compared.
        self.levels = []
        for depth, (patterns, masks) in enumerate(levels):
            if depth + 1 < len(levels):
                masks = masks & ~levels[depth + 1][1][np.arange(len(masks)) // FANOUT]
            self.levels.append((patterns, masks))

    def within(self, queries: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query's number and an indexed value's at most so many bits apart."""
        who = np.arange(len(queries))
        node = np.zeros(len(queries), dtype="int64")
        apart = np.zeros(len(queries), dtype="int64")
        for depth in range(len(self.levels) - 1, -1, -1):
            patterns, masks = self.levels[depth]
            if depth < len(self.levels) - 1:
                who = np.repeat(who, FANOUT)
                apart = np.repeat(apart, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                real = node < len(patterns)
                who, node, apart = who[real], node[real], apart[real]
            apart = apart + np.bitwise_count((queries[who] ^ patterns[node]) & masks[node])
            close = apart <= most
            who, node, apart = who[close], node[close], apart[close]
        return who, node


def smallest_labels(size: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """For each of ``size`` nodes the smallest one it is linked with."""
    labels = np.arange(size) if labels is None else labels
    while True:
        new = labels.copy()
        low = np.minimum(labels[a], labels[b])
        for end in (a, b):
            np.minimum.at(new, labels[end], low)
            np.minimum.at(new, end, low)
        new = new[new]
        if np.array_equal(new, labels):
            return labels
        labels = new


def group_links(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the group's distinct fingerprints as all close pairs would."""
    index = GrayIndex(values)
    size = len(values)
    labels = np.arange(size)
    for first in range(0, size, 1024):
        who, node = index.within(index.values[first : first + 1024], most)
        who = who + first
        pairs = who < node
        labels = smallest_labels(size, who[pairs], node[pairs], labels)
    moved = np.flatnonzero(labels != np.arange(size))
    return index.values[moved], index.values[labels[moved]]


def _block(fp: Column, number: int, blocks: int) -> Column:
    first, last = 64 * number // blocks, 64 * (number + 1) // blocks
    return F.shiftrightunsigned(F.shiftleft(fp, first), 64 - (last - first))


def close_links(values: DataFrame, max_bits: int = 2, chunk: int = 4096) -> DataFrame:
    """``u, v``: links between distinct fingerprints ``fp`` at most ``max_bits`` apart."""
    ensure_shipped(values.sparkSession)
    blocks = max_bits + 1
    keys = [
        F.struct(F.lit(i).alias("block"), _block(F.col("fp"), i, blocks).alias("bits"))
        for i in range(blocks)
    ]
    keyed = values.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.*")
    sizes = keyed.groupBy("block", "bits").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    chunks = F.ceil(F.col("n") / chunk)
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    cells = (
        keyed.join(sizes, ["block", "bits"])
        .withColumn("chunks", chunks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .select(
            "block",
            "bits",
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
            "fp",
        )
    )
    order = ["block", "bits", "low", "high"]
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, values in _runs(batches, order):
            del key
            if len(values) > 1:
                u, v = group_links(values.view("u8"), max_bits)
                if len(u):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(u.view("i8")), pa.array(v.view("i8"))], names=["u", "v"]
                    )

    return cells.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch], order: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Fingerprints of each run of equal keys, one run in memory at a time."""
    open_key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(n).to_numpy() for n in order]
        values = batch.column("fp").to_numpy()
        new = np.zeros(len(values), dtype=bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), len(values)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(int(k[a]) for k in keys)
            if key != open_key:
                if parts:
                    yield open_key, np.concatenate(parts)
                open_key, parts = key, []
            parts.append(values[a:b])
    if parts:
        yield open_key, np.concatenate(parts)


def near_copies(marked: DataFrame, id_col: str = "doc_id", max_bits: int = 2) -> DataFrame:
    """Add ``component_id``, the smallest id reachable over close fingerprints.

    ``marked`` has ``fp`` and must be stored, as it is read twice. Rows with one
    fingerprint count once in the search. Null ids are reachable but never the
    smallest; a component of them alone has a null id.
    """
    values = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "fingerprints")
    links = materialize(close_links(values.select("fp"), max_bits), "links")
    roots = materialize(components(links), "roots")
    of = values.join(roots, values["fp"] == roots["node"], "left").select(
        values["fp"], "least", F.coalesce("root", values["fp"]).alias("root")
    )
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    kept = [c for c in marked.columns if c != "component_id"]
    return marked.select(*kept).join(named, F.col("fp") == F.col("_fp")).select(*kept, "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def fingerprint_components(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint in hex and the id of its component.

    A null or empty text has fingerprint zero and is linked like any other.
    Repeated rows share a fingerprint. An empty table gives an empty table.
    """
    marked = materialize(
        fingerprints(docs.select("doc_id", "text"), drop_text=True).drop("row"), "marked"
    )
    return near_copies(marked).select(
        "doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id"
    )


def keep_one_of_component(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2
) -> DataFrame:
    """One document of each component of close fingerprints, the one with the smallest id.

    Fingerprints and links as in ``fingerprint_components``; a null or empty text
    has fingerprint zero and is linked like any other. Among rows of one id the
    first stored stays; null ids come last. Columns of any names pass through.
    An empty table gives an empty table. Texts are stored once; the rows that
    stay come back to them by number.
    """
    wrapped = docs.select(
        F.struct(*docs.columns).alias("_in"),
        F.col(id_col).alias("_id"),
        F.coalesce(text_col, F.lit("")).alias("_text"),
    )
    marked = materialize(fingerprints(wrapped, "_text", shingle, drop_text=True), "marked")
    place = F.struct(F.col("_id").isNull().alias("last"), "_id", "row")
    values = materialize(marked.groupBy("fp").agg(F.min(place).alias("place")), "fingerprints")
    links = materialize(close_links(values.select("fp"), max_bits), "links")
    roots = materialize(components(links), "roots")
    stays = (
        values.join(roots, values["fp"] == roots["node"], "left")
        .groupBy(F.coalesce("root", values["fp"]))
        .agg(F.min("place").alias("place"))
        .select(F.col("place.row").alias("row"))
    )
    # Those that stay grow with the documents: the same plan, a merge, at any size.
    return marked.join(materialize(stays, "stays").hint("merge"), "row", "left_semi").select("_in.*")


LINK = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def hash_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """``row, hashes``: the distinct shingle hashes of each ``_text``, eight bytes each."""
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("hashes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [distinct_hashes(shingle_hashes(t, shingle)).tobytes() for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sets, pa.binary())], names=["row", "hashes"])

    return rows.select("row", "_text").mapInArrow(run, schema)


def similar_sets(pairs: DataFrame, similarity: float) -> DataFrame:
    """Of ``u, v, set_u, set_v`` the pairs whose hash sets have that Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = []
            for a, b in zip(batch.column("set_u"), batch.column("set_v"), strict=True):
                x, y = (np.frombuffer(v.as_py(), dtype="u8") for v in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                close.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            picked = batch.select(["u", "v"]).filter(pa.array(close, pa.bool_()))
            yield pa.RecordBatch.from_arrays(picked.columns, names=["u", "v"])

    return pairs.mapInArrow(run, LINK)


def set_pairs(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each pair of sets, first before second, whether it has that Jaccard similarity."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], dtype="f8")
    ids, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    who = np.repeat(np.arange(n), sizes.astype("int64"))
    order = np.argsort(ids, kind="stable")
    starts = np.cumsum(df) - df
    both = np.zeros((n, n), dtype="f4")
    heavy = np.flatnonzero(df > max(2, n // 32))
    # Hashes of many sets by products of zeros and ones, the others pair by pair.
    column = np.full(len(df), -1)
    column[heavy] = np.arange(len(heavy))
    of = column[ids]
    for first in range(0, len(heavy), 4096):
        mine = (of >= first) & (of < first + 4096)
        block = np.zeros((n, min(4096, len(heavy) - first)), dtype="f4")
        block[who[mine], of[mine] - first] = 1
        both += block @ block.T
    light = np.flatnonzero((df > 1) & (column < 0))
    for times in np.unique(df[light]):
        at = starts[light[df[light] == times]]
        holders = [who[order[at + i]] for i in range(times)]
        for i in range(times):
            for j in range(i + 1, times):
                np.add.at(both, (holders[i], holders[j]), 1)
    return np.triu(both >= similarity * (sizes[:, None] + sizes - both) - 1e-9, 1)


def _cell_links(cells: DataFrame, similarity: float) -> DataFrame:
    """Links that join each cell's rows as all its similar pairs would.

    ``cells`` has ``key, low, high, own, row, part, hashes``; rows of one part are
    linked already, and those of two chunks meet only each other where they differ.
    """
    order = ["key", "low", "high"]

    def linked(rows: pa.Table) -> pa.RecordBatch:
        row, part, own = (rows.column(n).to_numpy() for n in ("row", "part", "own"))
        close = part[:, None] != part
        if rows.column("low")[0] != rows.column("high")[0]:
            close &= own[:, None] != own
        if close.any():
            close &= set_pairs([np.frombuffer(x.as_py(), dtype="u8") for x in rows.column("hashes")], similarity)
        # Parts stand for their rows, so that links between the same two are one.
        a, b = np.nonzero(close)
        labels = smallest_labels(len(row), a, b)
        moved = np.flatnonzero(labels != np.arange(len(row)))
        return pa.RecordBatch.from_arrays([pa.array(row[moved]), pa.array(row[labels[moved]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(n).to_numpy() for n in order]
            new = np.zeros(batch.num_rows, dtype=bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(int(k[a]) for k in keys)
                if key != open_key:
                    if parts:
                        yield linked(pa.Table.from_batches(parts))
                    open_key, parts = key, []
                parts.append(batch.slice(a, b - a))
        if parts:
            yield linked(pa.Table.from_batches(parts))

    return cells.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, LINK)


def set_links(
    keyed: DataFrame, roots: DataFrame | None, stored: DataFrame, shingle: int, similarity: float,
    small_group: int, chunk: int, more: DataFrame | None = None,
    whole: bool = False,
) -> DataFrame:
    """Links between rows that share a key, joining them as all similar pairs would.

    ``keyed`` has ``row, size, key``, ``stored`` the texts; rows of one root are
    linked already and not compared. Groups with few pairs left a row are compared
    pair by pair, along with the pairs of ``more``. Others are cut into cells of
    two chunks each, where every pair still meets. ``whole`` says that ``keyed`` has
    all keys of ``prefix_of``: then pairs that share too few of them are left out, as
    beyond the prefix that ends first a pair shares no more than the rest of that set.
    """
    if roots is not None:
        keyed = keyed.join(roots, keyed["row"] == roots["node"], "left").select(
            "row", "size", "key", F.coalesce("root", "row").alias("part")
        )
    else:
        keyed = keyed.select("row", "size", "key", F.col("row").alias("part"))
    n, total = F.col("n"), F.col("total")
    groups = (
        keyed.groupBy("key", "part")
        .agg(F.count("*").alias("c"), F.sum("size").alias("s"))
        .groupBy("key")
        .agg(
            F.sum("c").alias("n"),
            F.sum(F.col("c") * F.col("c")).alias("same"),
            F.sum("s").alias("total"),
            F.count("*").alias("parts"),
            F.max(F.struct("c", "part")).alias("top"),
        )
        .where(F.col("parts") > 1)
        .select(
            "key",
            F.col("top.part").alias("top"),
            F.when(n * n - F.col("same") > 2 * small_group * n, F.ceil(F.greatest(n / chunk, total / (chunk << 12))))
            .otherwise(0)
            .alias("chunks"),
        )
    )
    groups = materialize(groups, "groups")
    open_ = materialize(keyed.join(groups, "key"), "shared-keys")
    few = open_.where(F.col("chunks") == 0)
    other = few.select("key", F.col("row").alias("v"), F.col("size").alias("size_v"), F.col("part").alias("part_v"))
    pairs = (
        few.where(F.col("part") != F.col("top"))
        .join(other, "key")
        .where(
            (F.col("part") != F.col("part_v"))
            & ((F.col("part_v") == F.col("top")) | (F.col("row") > F.col("v")))
            # Sets whose sizes differ by more cannot be so similar.
            & (F.least("size", "size_v") >= similarity * F.greatest("size", "size_v") - 1e-9)
        )
    )
    pairs = pairs.select(F.col("row").alias("u"), "v", "size", "size_v")
    if whole:
        # A pair that also shares keys of groups in cells is compared there, whatever is counted here.
        rest = F.greatest(*(F.ceil(similarity * F.col(n) - 1e-9) - 1 for n in ("size", "size_v")))
        both = similarity / (1 + similarity) * (F.col("size") + F.col("size_v"))
        met = pairs.groupBy(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).agg(
            F.count("*").alias("met"), F.first(both - rest).alias("least")
        )
        pairs = met.where(F.col("met") >= F.col("least") - 1e-6)
    pairs = pairs.select("u", "v")
    if more is not None:
        pairs = pairs.union(more.select("u", "v"))
    pairs = pairs.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    pairs = materialize(pairs.distinct(), "pairs")
    own = F.pmod(F.xxhash64("row"), F.col("chunks"))
    cells = (
        open_.where(F.col("chunks") > 0)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .select(
            "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "row", "part"
        )
    )
    needed = pairs.select(F.col("u").alias("row")).union(pairs.select("v"))
    needed = needed.union(open_.where(F.col("chunks") > 0).select("row")).distinct()
    needed = materialize(needed, "needed")
    sets = materialize(hash_sets(stored.join(needed, "row", "left_semi"), shingle), "hash-sets")
    with_sets = pairs.join(sets.select(F.col("row").alias("u"), F.col("hashes").alias("set_u")), "u").join(
        sets.select(F.col("row").alias("v"), F.col("hashes").alias("set_v")), "v"
    )
    links = similar_sets(with_sets, similarity).union(_cell_links(cells.join(sets, "row"), similarity))
    return materialize(links, "verified")


def _late_last(marked: DataFrame, last: np.ndarray, shingle: int, similarity: float) -> DataFrame:
    """``row, keys`` with the hashes in ``last`` after all others; only texts with such keys are read again."""
    sent = marked.sparkSession.sparkContext.broadcast(last)
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = sent.value
        for batch in batches:
            keys = []
            for old, text in zip(batch.column("keys"), batch.column("_text"), strict=True):
                values = old.values.to_numpy().view("u8") if len(old) else np.empty(0, dtype="u8")
                if len(last) and len(values):
                    at = np.minimum(np.searchsorted(last, values), len(last) - 1)
                    if (last[at] == values).any():
                        values = prefix_of(distinct_hashes(shingle_hashes(text.as_py(), shingle)), similarity, last)
                keys.append(values.view("i8"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(keys, pa.list_(pa.int64()))], names=["row", "keys"])

    return marked.select("row", "keys", "_text").mapInArrow(run, schema)


def keep_one_of_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    max_bits: int = 2,
    first_keys: int = 4,
    small_group: int = 16,
    chunk: int = 512,
    common: int = 256,
) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Links are pairs with a Jaccard similarity of ``similarity`` over word
    shingles, verified on whole texts, and all such pairs are reached: texts so
    similar share one of their first shingle hashes in any common order, see
    ``prefix_of``. The order is by hash; hashes that stand in over ``common``
    prefixes come last, so that a passage of many texts makes no large groups.
    Pairs that the Gray-order index finds and those that share one of the first
    ``first_keys`` hashes are linked first. Then all keys are searched for pairs
    of texts that are not linked yet. ``set_links`` tells how groups are compared.

    Equal texts count once in the search. Null and empty texts are copies of
    each other. Among rows of one id the first stored stays; null ids come last.
    Columns of any names pass through. An empty table gives an empty table.
    """
    wrapped = docs.select(
        F.struct(*docs.columns).alias("_in"),
        F.col(id_col).alias("_id"),
        F.coalesce(text_col, F.lit("")).alias("_text"),
    )
    # The text is stored once, in its row.
    marked = materialize(fingerprints(wrapped, "_text", shingle, drop_text=True, similarity=similarity), "marked")
    stored = marked.select("row", "keys", F.coalesce(F.col("_in")[text_col], F.lit("")).alias("_text"))
    place = F.struct(F.col("_id").isNull().alias("last"), "_id", "row")
    light = marked.select("fp", F.xxhash64(F.coalesce(F.col("_in")[text_col], F.lit(""))).alias("_digest"), "row", "_id", "size")
    texts = materialize(
        light.groupBy("fp", "_digest")
        .agg(F.min(place).alias("place"), F.first("size").alias("size"))
        .select("fp", "place", F.col("place.row").alias("row"), "size"),
        "distinct-texts",
    )
    counts = marked.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    counts = materialize(counts.where(F.col("n") > common), "key-counts")
    # At most a million of them, whatever the size.
    least = (marked.agg(F.sum(F.size("keys"))).first()[0] or 0) >> 20
    often = counts.where(F.col("n") > least).select("key").toArrow().column("key").to_numpy()
    late = _late_last(stored, np.sort(often.view("u8")), shingle, similarity)
    keyed = late.join(texts.select("row", "size"), "row").select("row", "size", F.posexplode("keys").alias("at", "key"))
    keyed = materialize(keyed, "keys")
    repeated = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("key")
    keyed = materialize(keyed.join(materialize(repeated, "repeated"), "key", "left_semi"), "repeated-keys")

    first = texts.groupBy("fp").agg(F.min("row").alias("row"))
    links = close_links(first.select("fp"), max_bits)
    of = lambda side, name: texts.select(F.col("fp").alias(side), F.col("row").alias(name))
    near = links.select(F.col("u").alias("fu"), F.col("v").alias("fv"))
    near = near.join(of("fu", "u"), "fu").join(first.select(F.col("fp").alias("fv"), F.col("row").alias("v")), "fv")
    alike = of("fu", "u").join(first.select(F.col("fp").alias("fu"), F.col("row").alias("v")), "fu")
    rule = (stored.drop("keys"), shingle, similarity, small_group, chunk)
    gray = near.select("u", "v").union(alike.select("u", "v"))
    links = set_links(keyed.where(F.col("at") < first_keys), None, *rule, more=gray)
    links = links.union(set_links(keyed, materialize(components(links), "roots"), *rule, whole=True))
    roots = materialize(components(links), "roots")
    stays = (
        texts.join(roots, texts["row"] == roots["node"], "left")
        .groupBy(F.coalesce("root", texts["row"]))
        .agg(F.min("place").alias("place"))
        .select(F.col("place.row").alias("row"))
    )
    stays = materialize(stays, "stays")
    return marked.join(stays, "row", "left_semi").select("_in.*")
