"""Removal of long byte strings that occur earlier, with a logarithmic family of suffix arrays.

Suffixes are ordered by their first ``length`` bytes, as that is all a match
needs; the order of equal-length prefixes is that of their 64-bit digests. The
work is spread over hash buckets:

1. Every window of ``length`` bytes has an anchor, the fragment of ``FRAGMENT``
   bytes in it with the least hash, the leftmost of equals. Equal windows have
   equal anchors. Batches of documents ask the buckets which of their anchors
   occur elsewhere.
2. Around the anchors that do, batches send the bytes of the windows they
   anchor. In its bucket one batch after another becomes a sorted array of
   (prefix, first place), which is scanned against the levels that hold all
   that came before: of two places of one prefix the later is a match. Then it
   is a level itself, and levels of like size are merged, linearly. Matches are
   compared byte by byte.
3. Batches get their matches back and cut the bytes they cover.

A batch sends equal surroundings once, so a text with a third of all copies
costs each bucket one entry for each batch. No text is sent whole to any one
task, and all windows of all documents are judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfvec.llm import batches as B

FRAGMENT = 32
#: Positions handled at once; 24 bits of a key hold a position.
SLICE = 1 << 20
BATCH_BYTES = 3 << 20
BUCKET_BYTES = 3 << 20
#: Windows that make a new batch of a family.
FAMILY_WINDOWS = 1 << 17

_draw = np.random.default_rng(20)
#: Fixed random 64-bit values of bytes, for fragments and for windows.
FRAGMENT_VALUES = _draw.integers(0, 1 << 64, 256, dtype="u8")
WINDOW_VALUES = _draw.integers(0, 1 << 64, 256, dtype="u8")
BASE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, size: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for the first positions; kept, as slices are of like size."""
    have = _powers.get(base)
    if have is None or len(have) < size:
        values = np.full(size, base, dtype="u8")
        values[0] = 1
        have = _powers[base] = np.multiply.accumulate(values)
    return have[:size]


def fragment_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the FRAGMENT bytes at each position that has so many."""
    h = FRAGMENT_VALUES[data]
    width, base = 1, BASE
    while width < FRAGMENT:
        h = h[:-width] * np.uint64(base) + h[width:]
        width, base = 2 * width, base * base % (1 << 64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    have, span = values, 1
    while 2 * span <= width:
        have = np.minimum(have[:-span], have[span:])
        span *= 2
    rest = width - span
    return np.minimum(have[:-rest], have[rest:]) if rest else have


class Windows:
    """Runs of neighbouring windows with one anchor, over documents put end to end.

    ``first`` and ``last`` are the first and last window start of each run,
    ``anchor`` the full hash of its anchor.
    """

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        self.data = np.frombuffer(b"".join(texts), dtype="u1")
        self.ends = np.cumsum([len(t) for t in texts])
        self.starts = self.ends - np.array([len(t) for t in texts])
        firsts, lasts, anchors = [], [], []
        width = length - FRAGMENT + 1
        for at in range(0, len(self.data), SLICE):
            part = self.data[at : at + SLICE + length - 1]
            if len(part) < length:
                break
            hashes = fragment_hashes(part)
            keys = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype="u8")
            place = (sliding_min(keys, width) & np.uint64(0xFFFFFF)).astype("int64")
            inside = self._inside(at, len(place))
            windows = np.flatnonzero(inside)
            if not len(windows):
                continue
            place = place[windows]
            new = np.ones(len(windows), dtype=bool)
            new[1:] = (np.diff(place) != 0) | (np.diff(windows) != 1)
            cut = np.flatnonzero(new)
            firsts.append(windows[cut] + at)
            lasts.append(windows[np.append(cut[1:], len(windows)) - 1] + at)
            # An anchor's hash is the least of many and so small; mixed, it says nothing of its size.
            anchors.append(hashes[place[cut]] * MIX)
        self.first = np.concatenate([*firsts, np.empty(0, "int64")]).astype("int64")
        self.last = np.concatenate([*lasts, np.empty(0, "int64")]).astype("int64")
        self.anchor = np.concatenate([*anchors, np.empty(0, "u8")]).astype("u8")

    def _inside(self, at: int, size: int) -> np.ndarray:
        """Which of the windows from a position on lie in one document."""
        marks = np.zeros(size + 1, dtype="i4")
        a = np.clip(self.starts - at, 0, size)
        b = np.clip(self.ends - self.length + 1 - at, 0, size)
        real = b > a
        np.add.at(marks, a[real], 1)
        np.add.at(marks, b[real], -1)
        return np.cumsum(marks[:-1]) > 0


def span_digests(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit digest of data[first:end] for each pair, whatever its place."""
    out = np.empty(len(first), dtype="u8")
    done = 0
    while done < len(first):
        # Spans in ascending order, as many as lie within one slice.
        at = int(first[done])
        upto = max(done + 1, int(np.searchsorted(first, at + SLICE)))
        stop = int(end[done:upto].max())
        values = WINDOW_VALUES[data[at:stop]] * powers(BASE, stop - at)
        sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(values, dtype="u8")])
        a, b = first[done:upto] - at, end[done:upto] - at
        digest = (sums[b] - sums[a]) * powers(BASE_INVERSE, int(a.max()) + 1)[a]
        digest ^= digest >> np.uint64(31)
        out[done:upto] = digest * np.uint64(0x94D049BB133111EB)
        done = upto
    return out


def _runs_to_positions(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each run, put end to end."""
    total = int(count.sum())
    steps = np.ones(total, dtype="int64")
    heads = np.cumsum(count) - count
    steps[heads] = first
    steps[heads[1:]] -= first[:-1] + count[:-1] - 1
    return np.cumsum(steps)


class SuffixFamily:
    """Sorted arrays of (prefix, place), each prefix with its first place, merged when of like size.

    A new array is scanned against the levels before it joins them. Of two
    places of one prefix the later one is a match, whichever came in first.
    """

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def _firsts(prefixes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted prefixes one each, with its least place."""
        heads = np.flatnonzero(np.concatenate([[True], prefixes[1:] != prefixes[:-1]])) if len(prefixes) else np.empty(0, "int64")
        return prefixes[heads], np.minimum.reduceat(places, heads) if len(heads) else places

    def _merged(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Two levels as one; a stable sort of two sorted runs is one linear merge."""
        prefixes = np.concatenate([a[0], b[0]])
        order = np.argsort(prefixes, kind="stable")
        return self._firsts(prefixes[order], np.concatenate([a[1], b[1]])[order])

    def add(self, prefixes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scan a batch against the levels and then make it one.

        Returns which of its suffixes have an earlier place in the batch or in a
        level, and the places in levels that turned out later than one of the batch.
        """
        order = np.argsort(prefixes, kind="stable")
        new, at = self._firsts(prefixes[order], places[order])
        later = np.zeros(len(new), dtype=bool)
        displaced = []
        for have, seen in self.levels:
            found = np.minimum(np.searchsorted(have, new), len(have) - 1)
            same = np.flatnonzero(have[found] == new)
            other = seen[found[same]]
            before = other < at[same]
            later[same[before]] = True
            displaced.append(other[~before])
        # Every suffix but the first of its prefix is later than that one.
        whose = np.searchsorted(new, prefixes)
        matched = later[whose] | (places != at[whose])
        self.levels.append((new, at))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(self._merged(a, b))
        return matched, np.concatenate([*displaced, np.empty(0, "int64")]).astype("int64")

    def first_places(self, prefixes: np.ndarray) -> np.ndarray:
        """The first place of each prefix over all levels."""
        first = np.full(len(prefixes), np.iinfo("int64").max)
        order = np.argsort(prefixes)
        wanted = prefixes[order]
        found = np.full(len(prefixes), np.iinfo("int64").max)
        for have, places in self.levels:
            at = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
            same = have[at] == wanted
            found[same] = np.minimum(found[same], places[at[same]])
        first[order] = found
        return first


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether ``length`` bytes from each pair of positions are equal, eight at a time."""
    words = np.ndarray((max(len(data) - 7, 0),), dtype="<u8", buffer=data, strides=(1,))
    same = np.ones(len(a), dtype=bool)
    for at in [*range(0, length - 8, 8), length - 8]:
        same &= words[a + at] == words[b + at]
    return same


class BucketMatches:
    """Which windows of one bucket have an earlier place, over its batches in turn."""

    def __init__(self, length: int, digest=span_digests):
        self.length, self.digest = length, digest

    def of(self, runs: list[tuple[bytes, np.ndarray, np.ndarray]], chunk: int) -> list[np.ndarray]:
        """``runs`` are each question's bytes, windows per run, and places of the runs' first windows.

        Questions are taken together until they have ``chunk`` windows; these
        are a batch of the family.
        """
        length = self.length
        data = np.frombuffer(b"".join(r[0] for r in runs), "u1")
        count = np.concatenate([r[1] for r in runs]).astype("int64")
        heads = np.cumsum(count + length - 1) - (count + length - 1)
        start = _runs_to_positions(heads, count)
        place = np.repeat(np.concatenate([r[2] for r in runs]) - heads, count) + start
        sizes = np.array([int(r[1].sum(dtype="int64")) for r in runs])
        ends = np.cumsum(sizes)
        family, matched, prefixes, displaced = SuffixFamily(), np.zeros(len(start), dtype=bool), np.empty(len(start), "u8"), []
        at = 0
        for end in ends.tolist():
            if end - at >= chunk or end == len(start) and end > at:
                part = slice(at, end)
                prefixes[part] = self.digest(data, start[part], start[part] + length)
                matched[part], moved = family.add(prefixes[part], place[part])
                displaced.append(moved)
                at = end
        order = np.argsort(place, kind="stable")
        moved = np.concatenate([*displaced, np.empty(0, "int64")])
        matched[order[np.searchsorted(place[order], moved)]] = True
        # Digests only led here: each match is compared with the first place of its prefix.
        hits = np.flatnonzero(matched)
        first = order[np.searchsorted(place[order], family.first_places(prefixes[hits]))]
        if not same_bytes(data, start[hits], start[first], length).all():
            matched = self._by_bytes(data, start, order)
        return np.split(matched, ends[:-1])

    def _by_bytes(self, data: np.ndarray, start: np.ndarray, order: np.ndarray) -> np.ndarray:
        """The same by the strings themselves, for a bucket in which two share a digest."""
        whole, seen = data.tobytes(), set()
        matched = np.zeros(len(start), dtype=bool)
        for i in order.tolist():
            part = whole[start[i] : start[i] + self.length]
            matched[i] = part in seen
            seen.add(part)
        return matched


class Surroundings:
    """The distinct runs of a batch whose anchors occur again, and their copies."""

    def __init__(self, windows: Windows, again: np.ndarray):
        self.runs = np.flatnonzero(again)
        first, last = windows.first[self.runs], windows.last[self.runs]
        digests = span_digests(windows.data, first, last + windows.length)
        sizes = (last - first).astype("u8")
        digests = digests * np.uint64(257) + sizes
        # The leftmost of equal runs stands for them; places ascend with document and start.
        _, lead, at = np.unique(digests, return_index=True, return_inverse=True)
        self.leads = np.zeros(len(self.runs), dtype=bool)
        self.leads[lead] = True

    def kept(self) -> np.ndarray:
        return self.runs[self.leads]

    def copies(self) -> np.ndarray:
        return self.runs[~self.leads]


def _in_order(ids: list, texts: list[bytes]) -> np.ndarray:
    """Documents of a batch by ascending id, nulls first."""
    return np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0)), dtype="int64")


def _groups(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    bucket = B.bucket_of(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(at):
            yield int(bucket[at[0]]), at


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: texts without bytes that occur earlier.

    Each byte goes that is covered by a string of ``length`` bytes which also
    starts earlier: in a document with a smaller id, or earlier in the same.
    Strings may overlap, do not cross documents, and are judged on the input.
    ``spans`` are the maximal removed runs as (start, end), ``kept`` the bytes
    that stay. Among equal ids the order of the stored batches counts; a null id
    comes before all others. A null text is empty. Repeated rows are copies like
    any other. An empty table gives an empty table; other columns are not read.

    Digests lead to matches within a bucket; the matches' bytes are compared.
    """
    if length <= FRAGMENT:
        raise ValueError(f"strings must be longer than {FRAGMENT} bytes")
    packed = B.pack_documents(docs, BATCH_BYTES)
    buckets = B.bucket_count(packed, BUCKET_BYTES)

    def anchors(ids: list, texts: list[bytes], _: dict) -> Iterator[tuple[int, object]]:
        windows = Windows([texts[i] for i in _in_order(ids, texts)], length)
        keys = np.unique(windows.anchor)
        for bucket, at in _groups(keys, buckets):
            yield bucket, keys[at]

    def elsewhere(asked: list) -> tuple[list, object]:
        _, at, times = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
        again = times[at] > 1
        return [np.packbits(x) for x in np.split(again, np.cumsum([len(q) for q in asked])[:-1])], None

    met = B.answer(B.ask(packed, anchors), buckets, elsewhere, "anchors-met")
    first_answers = B.with_answers(packed, met).select("batch", "size", "load", "answers")

    def again_in(windows: Windows, answers: dict) -> np.ndarray:
        """Whether each run's anchor occurs again, in this batch or another."""
        keys, at, times = np.unique(windows.anchor, return_inverse=True, return_counts=True)
        again = times > 1
        for bucket, place in _groups(keys, buckets):
            again[place] |= np.unpackbits(answers[bucket], count=len(place)).astype(bool)
        return again[at]

    def surroundings(ids: list, texts: list[bytes], answers: dict) -> Iterator[tuple[int, object]]:
        order = _in_order(ids, texts)
        windows = Windows([texts[i] for i in order], length)
        again = again_in(windows, answers)
        runs = Surroundings(windows, again).kept()
        doc = np.searchsorted(windows.ends, windows.first[runs], side="right")
        doc_ids = np.array([np.iinfo("int64").min if ids[i] is None else ids[i] for i in order], dtype="int64")
        yield B.NOTES, np.packbits(again)  # what the last pass needs of the first answers
        for bucket, at in _groups(windows.anchor[runs], buckets):
            mine = runs[at]
            first, count = windows.first[mine], windows.last[mine] - windows.first[mine] + 1
            data = windows.data[_runs_to_positions(first, count + length - 1)]
            start = first - windows.starts[doc[at]]
            yield bucket, (data.tobytes(), count.astype("u2"), doc_ids[doc[at]], start, order[doc[at]])

    def matches(asked: list) -> tuple[list, object]:
        if not isinstance(asked[0], tuple):
            return asked, None  # the batches' own notes
        docs_of = np.concatenate([q[2] for q in asked])
        batch_of = np.repeat(np.arange(len(asked)), [len(q[2]) for q in asked])
        places = np.lexsort(
            (np.concatenate([q[3] for q in asked]), np.concatenate([q[4] for q in asked]), batch_of, docs_of)
        )
        rank = np.empty(len(places), dtype="int64")
        rank[places] = np.arange(len(places))
        cuts = np.cumsum([len(q[2]) for q in asked])[:-1]
        runs = [(q[0], q[1], r * length) for q, r in zip(asked, np.split(rank, cuts), strict=True)]
        return [np.packbits(x) for x in BucketMatches(length).of(runs, FAMILY_WINDOWS)], None

    asked = B.ask(first_answers, surroundings)
    matched = B.answer(asked, buckets, matches, "matches")
    answered = B.with_answers(packed, matched).select("batch", "load", "answers")

    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("n_bytes", T.LongType(), False),
            T.StructField(
                "spans",
                T.ArrayType(
                    T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]), False
                ),
                False,
            ),
            T.StructField("kept", T.BinaryType(), False),
        ]
    )

    def cut(ids: list, texts: list[bytes], answers: dict) -> list[pa.Array]:
        order = _in_order(ids, texts)
        windows = Windows([texts[i] for i in order], length)
        again = np.unpackbits(answers[B.NOTES], count=len(windows.first)).astype(bool)
        runs = Surroundings(windows, again)
        covered = np.zeros(len(windows.data) + 1, dtype="i4")
        np.add.at(covered, windows.first[runs.copies()], 1)
        np.add.at(covered, windows.last[runs.copies()] + length, -1)
        kept = runs.kept()
        for bucket, at in _groups(windows.anchor[kept], buckets):
            mine = kept[at]
            count = windows.last[mine] - windows.first[mine] + 1
            start = _runs_to_positions(windows.first[mine], count)
            hit = start[np.unpackbits(answers[bucket], count=len(start)).astype(bool)]
            np.add.at(covered, hit, 1)
            np.add.at(covered, hit + length, -1)
        gone = np.cumsum(covered[:-1]) > 0
        spans, parts = [], []
        for a, b in zip(windows.starts, windows.ends, strict=True):
            mask = gone[a:b]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype("i1")))
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2], strict=True)])
            parts.append(windows.data[a:b][~mask].tobytes())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return [
            pa.array([ids[i] for i in order], pa.int64()),
            pa.array(windows.ends - windows.starts, pa.int64()),
            pa.array(spans, kind),
            pa.array(parts, pa.binary()),
        ]

    return B.map_documents(answered, schema, cut)


def repeat_digests(docs: DataFrame) -> DataFrame:
    """Per document the bytes and runs removed and the digest of what stays."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return remove_repeats(docs).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
