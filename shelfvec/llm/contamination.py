"""Documents that hold test items, by BM25 search with block-max WAND.

The test items are indexed: a posting list per term, cut into blocks that carry
their largest weight. Every window of every document is a query. A window
whose terms cannot reach the score in any run of items is passed over; the others
run block-max WAND and get all items whose BM25 score reaches a share of the score that the
item's own text would get. Each item found is then verified: the five-word
shingles of its question and of its answer must stand in the window.

Items are a bounded set that travels to the workers; ``MAX_ITEM_CHARS`` is
checked. Documents stay where they are: no shuffle.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfvec.llm.words import words_of
from shelfvec.sources.shipping import ensure_shipped

MAX_ITEM_CHARS = 64 << 20
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’…–—¿¡·"
MEMO_WORDS = 400_000
#: Runs of items with a bound of their own in the first look at a window.
RUNS = 512

LEAK = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("word_at", T.LongType(), False),
        T.StructField("score", T.DoubleType(), False),
        T.StructField("question_overlap", T.DoubleType(), False),
        T.StructField("answer_overlap", T.DoubleType(), False),
    ]
)


@dataclass(frozen=True)
class Search:
    """``min_score``: share of an item's own BM25 score. Overlaps: shares of shingles.

    Windows hold twice as many words as the longest item, ``least_words`` at
    least, and start half a window apart, so an item's words stand whole in one.
    """

    min_score: float = 0.6
    min_overlap: float = 0.8
    min_part_overlap: float = 0.5
    shingle: int = 5
    k1: float = 1.2
    b: float = 0.75
    block: int = 16
    least_words: int = 64


def plain(word: str) -> str:
    return word.lower().strip(PUNCTUATION)


def plain_words(text: str | None) -> list[str]:
    return [w for w in map(plain, words_of(text)) if w]


def shingles(words: list[str], size: int) -> list[tuple[str, ...]]:
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def question_and_answer(text: str | None, size: int) -> tuple[list, list]:
    """Shingles of the part up to the first question mark, or half the words, and of the rest.

    Shingles across the two belong to the answer.
    """
    words = plain_words(text)
    mark = (text or "").find("?")
    cut = len(plain_words(text[: mark + 1])) if mark >= 0 else 0
    if not 0 < cut < len(words):
        cut = len(words) // 2
    if len(words) < size:
        return shingles(words, size), []
    first = max(1, cut - size + 1)
    whole = shingles(words, size)
    return whole[:first], whole[first:]


class Cursor:
    __slots__ = ("items", "weights", "most", "lasts", "mosts", "at", "size")

    def __init__(self, posting: tuple):
        self.items, self.weights, self.most, self.lasts, self.mosts, self.size = posting
        self.at = 0


class ItemIndex:
    """BM25 weights of terms in items, each divided by the item's own score."""

    def __init__(self, items: list[tuple[int, str | None]], rule: Search):
        self.rule = rule
        rows = [(i, t, plain_words(t)) for i, t in items]
        rows = [r for r in rows if r[2]]
        self.item_ids = [r[0] for r in rows]
        self.parts = [question_and_answer(r[1], rule.shingle) for r in rows]
        self.window = 2 * max([rule.least_words, *(len(r[2]) for r in rows)])
        usual = sum(len(r[2]) for r in rows) / max(1, len(rows))
        counts: list[dict[str, int]] = []
        found_in: dict[str, int] = {}
        for _, _, words in rows:
            own: dict[str, int] = {}
            for w in words:
                own[w] = own.get(w, 0) + 1
            counts.append(own)
            for w in own:
                found_in[w] = found_in.get(w, 0) + 1
        self.terms = {w: k for k, w in enumerate(sorted(found_in))}
        idf = {w: math.log(1 + (len(rows) - n + 0.5) / (n + 0.5)) for w, n in found_in.items()}
        postings: list[tuple[list, list]] = [([], []) for _ in self.terms]
        for k, own in enumerate(counts):
            length = rule.k1 * (1 - rule.b + rule.b * len(rows[k][2]) / usual)
            raw = {w: idf[w] * n * (rule.k1 + 1) / (n + length) for w, n in own.items()}
            total = sum(raw.values())
            for w, x in sorted(raw.items()):
                items_of, weights = postings[self.terms[w]]
                items_of.append(k)
                weights.append(x / total)
        self.postings = [self._blocks(p, rule.block) for p in postings]
        #: Largest weight of each term in each run of items; windows are tried on it first.
        self.run = max(1, -(-len(rows) // RUNS))
        self.coarse = np.zeros((len(self.terms) + 1, max(1, -(-len(rows) // self.run))), dtype="f4")
        for k, (items_of, weights) in enumerate(postings):
            np.maximum.at(self.coarse[k], np.array(items_of) // self.run, weights)
        self.memo: dict[str, int] = {}

    @staticmethod
    def _blocks(posting: tuple[list, list], block: int) -> tuple:
        items, weights = posting
        cuts = range(0, len(items), block)
        lasts = [items[min(a + block, len(items)) - 1] for a in cuts]
        mosts = [max(weights[a : a + block]) for a in cuts]
        return items, weights, max(weights), lasts, mosts, len(items)

    def term_ids(self, words: list[str]) -> np.ndarray:
        """Term numbers; the last one stands for words outside the index."""
        memo, unknown = self.memo, len(self.terms)
        if len(memo) > MEMO_WORDS:
            memo.clear()
        out = []
        for w in words:
            k = memo.get(w)
            if k is None:
                k = memo[w] = self.terms.get(plain(w), unknown)
            out.append(k)
        return np.array(out, dtype="int64")

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items of which the distinct terms score at least ``min_score``."""
        least = self.rule.min_score - 1e-9
        cursors = [Cursor(self.postings[t]) for t in terms]
        found = []
        while cursors:
            cursors.sort(key=lambda c: c.items[c.at])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c.most
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot].items[cursors[pivot].at]
            last = pivot
            while last + 1 < len(cursors) and cursors[last + 1].items[cursors[last + 1].at] == item:
                last += 1
            bound, skip = 0.0, None
            for c in cursors[: last + 1]:
                b = bisect_left(c.lasts, item)
                if b < len(c.lasts):
                    bound += c.mosts[b]
                    skip = c.lasts[b] if skip is None else min(skip, c.lasts[b])
            if bound < least:
                # No item up to the nearest block end can reach the score.
                target = (item if skip is None else skip) + 1
                if last + 1 < len(cursors):
                    target = min(target, cursors[last + 1].items[cursors[last + 1].at])
            elif cursors[0].items[cursors[0].at] == item:
                score = sum(c.weights[c.at] for c in cursors[: last + 1])
                if score >= least:
                    found.append((item, score))
                target = item + 1
            else:
                target = item
            for c in cursors[: last + 1]:
                if c.items[c.at] < target:
                    c.at = bisect_left(c.items, target, c.at + 1)
            cursors = [c for c in cursors if c.at < c.size]
        return found

    def leaks(self, text: str | None) -> list[tuple[int, int, float, float, float]]:
        """Verified items of a text, each with its best window."""
        words = words_of(text)
        if not words or not self.item_ids:
            return []
        rule, half = self.rule, self.window // 2
        ids = self.term_ids(words)
        # Distinct known terms of each half window, and what they can give in each run of items.
        unknown = len(self.terms)
        keys = np.unique(np.arange(len(ids)) // half * (unknown + 1) + ids)
        part, term = np.divmod(keys, unknown + 1)
        parts = int(part[-1]) + 1
        bounds = np.add.reduceat(self.coarse[term], np.searchsorted(part, np.arange(parts)))
        if parts > 1:
            bounds = bounds[:-1] + bounds[1:]
        hopeful = np.flatnonzero(bounds.max(axis=1) >= rule.min_score - 1e-4)
        best: dict[int, tuple] = {}
        for number in hopeful.tolist():
            a, b = number * half, number * half + self.window
            terms = np.unique(ids[a:b])
            hits = self.search([t for t in terms.tolist() if t < unknown])
            if not hits:
                continue
            seen = set(shingles([w for w in map(plain, words[a:b]) if w], rule.shingle))
            for item, score in hits:
                question, answer = self.parts[item]
                shares = [sum(s in seen for s in part) for part in (question, answer)]
                if self._verified(shares, question, answer, seen):
                    overlaps = [n / max(1, len(p)) for n, p in zip(shares, (question, answer), strict=True)]
                    new = (score, overlaps[0], overlaps[1] if answer else overlaps[0])
                    if item not in best or sum(new) > sum(best[item][1:]):
                        best[item] = (a, *new)
        return [(self.item_ids[k], *row) for k, row in sorted(best.items())]

    def _verified(self, shares: list[int], question: list, answer: list, seen: set) -> bool:
        rule = self.rule
        if not answer and len(question[0]) < rule.shingle:
            # A shorter item than a shingle: its words in a row.
            size = len(question[0])
            return any(question[0] in {s[i : i + size] for i in range(len(s))} for s in seen)
        total = sum(shares) / (len(question) + len(answer))
        return total >= rule.min_overlap - 1e-9 and all(
            n >= rule.min_part_overlap * len(p) for n, p in zip(shares, (question, answer), strict=True)
        )


#: The index of the query at work, made once per worker.
_indexes: dict[str, ItemIndex] = {}


def mark_leaks(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    rule: Search | None = None,
    drop_text: bool = False,
) -> DataFrame:
    """Add ``leaks``: the items a document holds, with window, score and overlaps.

    Null or empty texts and items without a word leak nothing. Repeated items are
    reported each. A column named ``leaks`` is replaced. Empty tables of items or
    documents give no leaks.
    """
    spark = docs.sparkSession
    ensure_shipped(spark)
    size = items.agg(F.sum(F.length(item_text)).alias("n")).first()["n"] or 0
    if size > MAX_ITEM_CHARS:
        raise ValueError(f"{size} characters of items; an index holds {MAX_ITEM_CHARS} at most")
    order = [F.col(item_id).asc_nulls_first(), F.col(item_text)]
    rows = [tuple(r) for r in items.select(item_id, item_text).orderBy(*order).collect()]
    sent, key = spark.sparkContext.broadcast((rows, rule or Search())), uuid.uuid4().hex
    rest = [f for f in docs.schema.fields if f.name not in {"leaks", *([text_col] if drop_text else [])}]
    kept = [f.name for f in rest]
    schema = T.StructType([*rest, T.StructField("leaks", T.ArrayType(LEAK, False), False)])
    names = LEAK.names
    kind = pa.list_(
        pa.struct([(names[0], pa.int64()), (names[1], pa.int64()), *((n, pa.float64()) for n in names[2:])])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _indexes:
            _indexes.clear()
            _indexes[key] = ItemIndex(*sent.value)
        index = _indexes[key]
        for batch in batches:
            found = [
                [dict(zip(names, x, strict=True)) for x in index.leaks(t)]
                for t in batch.column(text_col).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in kept] + [pa.array(found, kind)], names=[*kept, "leaks"]
            )

    return docs.mapInArrow(run, schema)


def leaks_of(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each document and item that it holds."""
    marked = mark_leaks(docs.select("doc_id", "text"), items, drop_text=True)
    found = marked.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
    return found.withColumns({c: F.round(c, 9) for c in ("score", "question_overlap", "answer_overlap")})


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item, with their own columns only."""
    own = "leaks" in docs.columns
    named = docs.withColumnRenamed("leaks", "_own_leaks") if own else docs
    clean = mark_leaks(named, items).where(F.size("leaks") == 0).select(*named.columns)
    return clean.withColumnRenamed("_own_leaks", "leaks") if own else clean
