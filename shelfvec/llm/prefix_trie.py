"""Prefix trie of conversations by vertical bitmaps.

A node of the trie stands for a sequence of first turns; its members are the
conversations that start with it. Conversations are cut into shards of
consecutive ids. A shard numbers its conversations and keeps, for each
(position, turn), the bitset of those that have this turn there. The trie is
walked depth first from the bitset of all: the first conversation left in a
parent names a posting, the intersection of both is a child, and its popcount
the number of members. What ends at a node is an intersection too.

Shards meet by a digest of the prefix: counts are summed, the ends of one node
stay a list of pieces in the order of shards. So a first turn that a third of
all conversations share is one row per shard. Sums over subtrees go through
the shards a second time: what a node adds is counted in the one shard that
holds its smallest member, each shard sums its own subtrees, and these sums
are added by node.

From the first turn that no other conversation has at that position on, a
conversation is alone. These tails, most of all turns, never enter a shard;
their nodes are made by expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfvec.llm.arrow_rows import running_digests, runs
from shelfvec.operators.joins import lookup_join
from shelfvec.operators.numbering import with_positions
from shelfvec.sources.scratch import materialize
from shelfvec.sources.shipping import ensure_shipped

#: Conversations of a shard, and turns after which a shard takes no more of them.
SHARD = 4096
SHARD_TURNS = 1 << 18

WORD = "[^\\x20\\x09-\\x0D]+"
NOTHING = hashlib.sha256().hexdigest()
#: Stands before a conversation's turns.
HEAD = -1

_LONGS = ("shard", "at", "depth", "a", "b", "pa", "pb", "n", "least", "words", "tail", "n_ends")
NODES = T.StructType([T.StructField(n, T.LongType()) for n in _LONGS]).add("ends", T.StringType())
SUMS = T.StructType([T.StructField(n, T.LongType()) for n in ("a", "b", "parent", "leaves", "saved")])


def bits_of(value: int) -> Iterator[int]:
    """The set bits in ascending order."""
    while value:
        low = value & -value
        yield low.bit_length() - 1
        value ^= low


def child_key(parent: bytes, turn: tuple[int, int]) -> bytes:
    """128 bits that stand for a prefix: a digest of the parent's and of the last turn's."""
    own = b"".join(x.to_bytes(8, "big", signed=True) for x in turn)
    return hashlib.blake2b(parent + own, digest_size=16).digest()


def halves(key: bytes) -> tuple[int, int]:
    return int.from_bytes(key[:8], "big", signed=True), int.from_bytes(key[8:], "big", signed=True)


class VerticalIndex:
    """Bitsets of a shard's conversations by (position, turn), by length and by what ends where."""

    def __init__(self, ids: list[int], turns: list[list[tuple[int, int, int]]], lengths: list[int]):
        """``turns`` are the (digest, digest, words) that go into the trie; ``lengths`` count all turns."""
        self.ids, self.turns = ids, turns
        holders: dict[tuple, list[int]] = {}
        longer: dict[int, list[int]] = {}
        ends: dict[int, list[int]] = {}
        tails = []
        for i, (mine, length) in enumerate(zip(turns, lengths, strict=True)):
            for at, (a, b, _) in enumerate(mine):
                holders.setdefault((at, a, b), []).append(i)
                longer.setdefault(at, []).append(i)
            if length == len(mine):
                ends.setdefault(length, []).append(i)
            else:
                tails.append(i)
        self.postings = {k: self.bitset(v) for k, v in holders.items()}
        self.longer = {k: self.bitset(v) for k, v in longer.items()}
        self.ends = {k: self.bitset(v) for k, v in ends.items()}
        self.tails = self.bitset(tails)

    def bitset(self, members: list[int]) -> int:
        out = bytearray(len(self.ids) // 8 + 1)
        for i in members:
            out[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(out, "little")

    def children(self, members: int, depth: int) -> Iterator[tuple[tuple[int, int, int], int]]:
        """Next turns of a node's members and the members that have them."""
        left = members & self.longer.get(depth, 0)
        while left:
            first = (left & -left).bit_length() - 1
            turn = self.turns[first][depth]
            child = left & self.postings[(depth, *turn[:2])]
            yield turn, child
            left ^= child

    def nodes(self) -> Iterator[tuple]:
        """Nodes in depth-first order: key, parent's key, depth, members, words, tail, ends."""
        root = bytes(16)
        stack = [(root, root, 0, self.bitset(list(range(len(self.ids)))), 0)]
        while stack:
            key, parent, depth, members, words = stack.pop()
            # A tail begins below the last turn of a lone member.
            alone = members & self.tails if members.bit_count() == 1 else 0
            tail = bool(alone) and len(self.turns[alone.bit_length() - 1]) == depth
            yield key, parent, depth, members, words, tail, members & self.ends.get(depth, 0)
            below = [
                (child_key(key, turn[:2]), key, depth + 1, child, turn[2]) for turn, child in self.children(members, depth)
            ]
            stack += reversed(below)


def shard_nodes(rows: DataFrame, shard: int, shard_turns: int) -> DataFrame:
    """Nodes of each shard. ``rows`` has ``conv_id, pos, a, b, words``; at ``HEAD`` ``a`` is the conversation's length."""
    ensure_shipped(rows.sparkSession)

    def walked(ids: list[int], turns: list, lengths: list[int]) -> Iterator[pa.RecordBatch]:
        index = VerticalIndex(ids, turns, lengths)
        out: list[tuple] = []
        for at, (key, parent, depth, members, words, tail, ends) in enumerate(index.nodes()):
            least = ids[(members & -members).bit_length() - 1]
            listed = [str(ids[i]) for i in bits_of(ends)]
            out.append(
                (ids[0], at, depth, *halves(key), *halves(parent), members.bit_count(), least, words, int(tail), len(listed), ",".join(listed))
            )
            if len(out) == 8192:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        arrays = [pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=NODES.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, turns, lengths, held = [], [], [], 0
        for (conv,), table in runs(batches, ["conv_id"], ["a", "b", "words"]):
            a, b, words = (table[n].to_pylist() for n in ("a", "b", "words"))
            ids.append(conv)
            lengths.append(a[0])
            turns.append(list(zip(a[1:], b[1:], words[1:], strict=True)))
            held += len(a)
            if len(ids) >= shard or held >= shard_turns:
                yield from walked(ids, turns, lengths)
                ids, turns, lengths, held = [], [], [], 0
        if ids:
            yield from walked(ids, turns, lengths)

    ordered = rows.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "pos")
    return ordered.mapInArrow(run, NODES)


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """What each shard's subtrees add to ``leaves`` and ``saved``, and the parent's smallest member.

    ``nodes`` has ``shard, at, depth, a, b, least`` and the whole trie's
    ``all_n, all_least, inner, words`` of the node.
    """
    names = ["depth", "a", "b", "least", "all_n", "all_least", "inner", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in runs(batches, ["shard"], names):
            depth, a, b, least, n, all_least, inner, words = (table[c].to_pylist() for c in names)
            size = len(depth)
            own = [x == y for x, y in zip(least, all_least, strict=True)]
            leaves = [int(o and not i) for o, i in zip(own, inner, strict=True)]
            saved = [(k - 1) * w if o else 0 for o, k, w in zip(own, n, words, strict=True)]
            above, path = [-1] * size, []
            for i, d in enumerate(depth):
                above[i] = path[d - 1] if d else -1
                path[d:] = [i]
            for i in range(size - 1, 0, -1):
                leaves[above[i]] += leaves[i]
                saved[above[i]] += saved[i]
            parents = [None if p < 0 else all_least[p] for p in above]
            arrays = [pa.array(c, pa.int64()) for c in (a, b, parents, leaves, saved)]
            yield pa.RecordBatch.from_arrays(arrays, names=SUMS.names)

    return nodes.repartition("shard").sortWithinPartitions("shard", "at").mapInArrow(run, SUMS)


def ordered_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, pos, a, b, words``: turns by position from 0, as two digests of role and text, with their words.

    Turns go by ``turn``, nulls first, equal ones by role and the text's digest.
    A null role or text is empty. Rows without an id have no conversation and
    are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    light = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("turn"),
        role.alias("role"),
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(text, role, F.lit(1)).alias("b"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    placed = with_positions(light, ["conv_id", "turn", "role", "a", "b"], "place")
    starts = placed.groupBy("conv_id").agg(F.min("place").alias("start"))
    placed = lookup_join(placed, starts, ["conv_id"])
    return placed.select("conv_id", (F.col("place") - F.col("start")).alias("pos"), "a", "b", "words")


def trie_of(turns: DataFrame, lengths: DataFrame, shard: int = SHARD, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the trie, one row each.

    ``turns`` has ``conv_id, pos, a, b, words`` and ``lengths`` ``conv_id, length``,
    also of conversations without turns; both must be stored. Columns of the
    result: ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.
    """
    often = turns.groupBy("pos", "a", "b").agg(F.count("*").alias("n")).where("n > 1")
    marked = lookup_join(turns, often.select("pos", "a", "b", F.lit(True).alias("often")), ["pos", "a", "b"])
    marked = materialize(marked.select("conv_id", "pos", "a", "b", "words", F.coalesce("often", F.lit(False)).alias("often")), "marked-turns")
    lone = marked.where("NOT often").groupBy("conv_id").agg(F.min("pos").alias("lone"))
    spans = materialize(lengths.join(lone, "conv_id", "left"), "spans")
    placed = lookup_join(marked.drop("often"), spans, ["conv_id"])
    shared = placed.where("lone IS NULL OR pos <= lone").select("conv_id", "pos", "a", "b", "words")
    heads = spans.select("conv_id", F.lit(HEAD).cast("long").alias("pos"), F.col("length").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("words"))
    parts = materialize(shard_nodes(shared.unionByName(heads), shard, shard_turns), "shard-nodes")

    key = ["a", "b"]
    nodes = parts.groupBy(*key).agg(
        F.max("depth").alias("depth"),
        F.max("pa").alias("pa"),
        F.max("pb").alias("pb"),
        F.sum("n").alias("all_n"),
        F.min("least").alias("all_least"),
        F.max("words").alias("words"),
        F.max("tail").alias("tail"),
        F.sum(F.when(F.col("n_ends") > 0, 1).otherwise(0)).alias("pieces"),
        F.max(F.when(F.col("n_ends") > 0, F.col("ends"))).alias("one_piece"),
    )
    nodes = materialize(nodes, "nodes")
    below = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("inner"))
    nodes = materialize(nodes.join(below, key, "left").withColumn("inner", F.coalesce("inner", F.lit(0))), "nodes-children")

    known = nodes.select(*key, "all_n", "all_least", "inner", "words")
    again = parts.select("shard", "at", "depth", *key, "least").join(known, key)
    sums = subtree_sums(again).groupBy(*key).agg(F.max("parent").alias("parent"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))

    name = F.concat_ws(":", "a", "b")
    spread = parts.where("n_ends > 0").join(nodes.where("pieces > 1").select(*key), key, "left_semi")
    hashes = running_digests(spread.select(name.alias("key"), F.col("shard").alias("segment"), F.col("ends").alias("piece")), ",")
    ends = F.when(F.col("pieces") == 0, NOTHING).when(F.col("pieces") == 1, F.sha2("one_piece", 256)).otherwise(F.col("sha256"))
    inner = (
        nodes.join(sums, key)
        .withColumn("key", name)
        .join(hashes, "key", "left")
        .select(
            F.col("all_least").alias("conv_id"),
            "depth",
            F.col("parent").alias("parent_conv_id"),
            F.col("all_n").alias("n_convs"),
            (F.col("inner") + F.col("tail")).alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"),
            ends.alias("ends_sha256"),
        )
    )
    tails = placed.where("pos > lone").select(
        "conv_id",
        (F.col("pos") + 1).alias("depth"),
        F.col("conv_id").alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"),
        (F.col("pos") + 1 < F.col("length")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("pos") + 1 == F.col("length"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NOTHING).alias("ends_sha256"),
    )
    return inner.unionByName(tails)


def prefix_trie(turns: DataFrame, shard: int = SHARD, **columns: str) -> DataFrame:
    """The trie of a table of conversations, as ``trie_of`` describes it.

    Order, nulls and ties as in ``ordered_turns``; repeated rows are turns one
    after another. Other columns are not read. An empty table has no node.
    """
    rows = materialize(ordered_turns(turns, **columns), "turns")
    lengths = rows.groupBy("conv_id").agg(F.count("*").alias("length"))
    return trie_of(rows, materialize(lengths, "lengths"), shard)


def borrowed(conv: Column) -> Column:
    """How many first turns a conversation borrows."""
    return F.crc32(conv.cast("string").cast("binary")) % 4


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths after each conversation c took the first turns of conversation c - c % 20.

    ``rows`` has ``conv_id, pos, a, b, words`` and must be stored.
    """
    base = F.col("conv_id") - F.col("conv_id") % 20
    lengths = materialize(rows.groupBy("conv_id").agg(F.count("*").alias("length")), "own-lengths")
    of_base = lengths.where(F.col("conv_id") % 20 == 0).select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    plans = lengths.withColumns({"base": base, "h": borrowed(F.col("conv_id"))}).join(of_base, "base", "left")
    plans = plans.withColumn("taken", F.least("h", F.coalesce("base_length", F.lit(0))))
    plans = materialize(plans.select("conv_id", "base", "h", "length", "taken"), "plans")
    own = lookup_join(rows, plans.select("conv_id", "h", "taken"), ["conv_id"]).where("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "a", "b", "words")
    # At most three turns of each base for the conversations near it.
    first = rows.where((F.col("conv_id") % 20 == 0) & (F.col("pos") < 3)).select(F.col("conv_id").alias("base"), "pos", "a", "b", "words")
    heads = plans.select("conv_id", "base", "taken").join(first, "base").where("pos < taken").select("conv_id", "pos", "a", "b", "words")
    new = plans.select("conv_id", (F.col("taken") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length"))
    return materialize(own.unionByName(heads), "rebuilt"), materialize(new, "new-lengths")


def rebuilt_trie(turns: DataFrame, shard: int = SHARD) -> DataFrame:
    """The registered query: the trie of rebuilt conversations. Nulls, ties and repeats as in ``prefix_trie``."""
    return trie_of(*rebuilt(materialize(ordered_turns(turns), "turns")), shard)


# Bit by bit over the bytes of the decimal id.
_CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda crc, byte: list_reduce([xor(crc, byte)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""

SQL = f"""
WITH own AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos, role, text
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, ({_CRC}) % 4 AS h FROM own),
heads AS (SELECT c.conv_id, o.pos, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos < c.h),
taken AS (SELECT conv_id, count(pos) AS n FROM (SELECT c.conv_id, h.pos FROM convs c LEFT JOIN heads h USING (conv_id)) GROUP BY conv_id),
turns AS (
    SELECT * FROM heads UNION ALL
    SELECT o.conv_id, o.pos - c.h + t.n AS pos, o.role, o.text
    FROM own o JOIN convs c USING (conv_id) JOIN taken t USING (conv_id) WHERE o.pos >= c.h),
walks AS (
    SELECT conv_id, 0 AS depth, '' AS prefix, 0 AS words FROM convs UNION ALL
    SELECT conv_id, pos + 1 AS depth,
           md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY pos)) AS prefix,
           len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM turns),
lengths AS (SELECT conv_id, max(depth) AS length FROM walks GROUP BY conv_id),
ids AS (SELECT depth, prefix, min(conv_id) AS id, count(*) AS n, any_value(words) AS words FROM walks GROUP BY depth, prefix),
named AS (SELECT w.conv_id AS member, i.* FROM walks w JOIN ids i USING (depth, prefix)),
parents AS (
    SELECT i.id, i.depth, any_value(p.id) AS parent FROM ids i LEFT JOIN named p ON p.member = i.id AND p.depth = i.depth - 1 GROUP BY ALL),
children AS (SELECT parent AS id, depth - 1 AS depth, count(*) AS n FROM parents WHERE depth > 0 GROUP BY ALL),
below AS (
    SELECT up.id, up.depth, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((down.n - 1) * down.words) AS saved
    FROM ids down JOIN named up ON up.member = down.id AND up.depth <= down.depth
    LEFT JOIN children c ON c.id = down.id AND c.depth = down.depth GROUP BY ALL),
ends AS (
    SELECT n.id, n.depth, sha256(string_agg(n.member::VARCHAR, ',' ORDER BY n.member)) AS digest
    FROM named n JOIN lengths l ON l.conv_id = n.member AND l.length = n.depth GROUP BY ALL)
SELECT i.id AS conv_id, i.depth::BIGINT AS depth, p.parent AS parent_conv_id, i.n AS n_convs, coalesce(c.n, 0) AS n_children,
       b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, coalesce(e.digest, '{NOTHING}') AS ends_sha256
FROM ids i JOIN parents p USING (id, depth) JOIN below b USING (id, depth)
LEFT JOIN children c USING (id, depth) LEFT JOIN ends e USING (id, depth)
"""
