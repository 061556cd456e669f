"""Removal of phrases from token lists, for word lists of any size.

Phrases are grouped by their first token in a trie, which is walked over the
tokens of an Arrow batch. At each token the longest phrase that begins there
counts; after it the walk goes on, so phrases do not overlap. A list larger
than a worker should hold is cut into tries by first token; each in turn notes
the longest match at every token, and the walk comes last.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfvec.functions.text import words
from shelfvec.operators.joins import measured_bytes
from shelfvec.sources.scratch import materialize
from shelfvec.sources.shipping import ensure_shipped

# Text bytes of the phrases of one trie.
TRIE_BYTES = 32 * 1024 * 1024
END = ""


def build_trie(phrases: Iterable[list[str]]) -> dict:
    """Nested dictionaries by token; ``END`` marks the end of a phrase."""
    root: dict = {}
    for phrase in phrases:
        node = root
        for token in phrase:
            node = node.setdefault(token, {})
        if phrase:
            node[END] = True
    return root


def longest_matches(trie: dict, tokens: list[str]) -> list[int]:
    """For each token how many tokens the longest phrase that begins there has."""
    return list_matches(trie, pa.array([tokens], pa.list_(pa.string()))).tolist()


def list_matches(trie: dict, lists: pa.ListArray) -> np.ndarray:
    """``longest_matches`` of the tokens of all lists, one after another.

    Only tokens that begin some phrase are looked at one by one.
    """
    flat, (_, lengths) = lists.flatten(), _shape(lists)
    ends = np.repeat(np.cumsum(lengths), lengths)
    out = np.zeros(len(flat), dtype="i4")
    at = np.flatnonzero(pc.is_in(flat, value_set=pa.array(list(trie), pa.string())).to_numpy(zero_copy_only=False))
    nodes = [trie[t] for t in flat.take(pa.array(at)).to_pylist()]
    size = 1
    while nodes:
        out[at[[END in node for node in nodes]]] = size
        inside = at + size < ends[at]
        at, nodes = at[inside], [node for node, more in zip(nodes, inside.tolist(), strict=True) if more]
        nodes = [node.get(t) for node, t in zip(nodes, flat.take(pa.array(at + size)).to_pylist(), strict=True)]
        at, nodes = at[[node is not None for node in nodes]], [node for node in nodes if node is not None]
        size += 1
    return out


def _shape(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and lengths of the lists in their flat values; a null is as long as an empty list."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype("int64")
    return np.concatenate([[0], np.cumsum(lengths)]), lengths


def without_matches(lists: pa.ListArray, sizes: np.ndarray) -> pa.Array:
    """Tokens of each list outside the matches, joined by one space. From left to right, no match overlaps one before it."""
    flat, (offsets, _) = lists.flatten(), _shape(lists)
    kept = np.ones(len(flat), dtype=bool)
    free = 0
    hits = np.flatnonzero(sizes)
    # A match ends in its own list, so one walk serves all lists.
    for at, size in zip(hits.tolist(), sizes[hits].tolist(), strict=True):
        if at >= free:
            free = at + size
            kept[at:free] = False
    left = np.concatenate([[0], np.cumsum(kept)])[offsets].astype("i4")
    lines = pa.ListArray.from_arrays(pa.array(left), flat.filter(pa.array(kept)), mask=lists.is_null())
    return pc.binary_join(lines, " ")


def drop_phrases(df: DataFrame, column: str, phrases: DataFrame, output: str | None = None, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``column`` without the phrases, its tokens joined by one space.

    ``column`` is a cleaned text, ``phrases`` a table with the string column
    ``phrase``; both are read as tokens between spaces, in their own case. From
    left to right the longest phrase is dropped. Null and blank phrases say
    nothing, a null text stays null, and repeats of a phrase do not matter.
    """
    output = output or column
    ensure_shipped(df.sparkSession)
    listed = phrases.select(words("phrase").alias("tokens")).where(F.size("tokens") > 0).distinct()
    listed = materialize(listed.withColumn("text", F.array_join("tokens", " ")), "phrases")
    shards = max(1, -(-measured_bytes(listed.select("text")) // trie_bytes))
    shard = F.pmod(F.xxhash64(F.element_at("tokens", 1)), F.lit(shards))
    df = df.withColumn("_tokens", words(column))
    if shards > 1:
        df = df.withColumn("_sizes", F.transform("_tokens", lambda _: F.lit(0)))
    for number in range(shards):
        # Bounded by the size of a shard.
        mine = listed.where(shard == number).select("tokens").toArrow().column("tokens").to_pylist()
        matches, dropped = _matcher(df, build_trie(mine))
        if shards == 1:
            # Tokens go through Python once.
            return df.withColumn(output, dropped("_tokens")).drop("_tokens")
        longest = F.zip_with("_sizes", matches("_tokens"), lambda a, b: F.greatest(a, b))
        df = materialize(df.withColumn("_sizes", longest), "phrase-matches")
    return df.withColumn(output, _walker()("_tokens", "_sizes")).drop("_tokens", "_sizes")


def _matcher(df: DataFrame, trie: dict):
    """Longest matches at each token of a list, and the list's text without the phrases."""
    sent = df.sparkSession.sparkContext.broadcast(trie)

    @F.arrow_udf("array<int>")
    def matches(tokens: pa.Array) -> pa.Array:
        offsets, _ = _shape(tokens)
        found = pa.array(list_matches(sent.value, tokens))
        return pa.ListArray.from_arrays(pa.array(offsets.astype("i4")), found, mask=tokens.is_null())

    @F.arrow_udf("string")
    def dropped(tokens: pa.Array) -> pa.Array:
        return without_matches(tokens, list_matches(sent.value, tokens))

    return matches, dropped


def _walker():
    @F.arrow_udf("string")
    def walked(tokens: pa.Array, sizes: pa.Array) -> pa.Array:
        return without_matches(tokens, sizes.flatten().to_numpy(zero_copy_only=False))

    return walked
