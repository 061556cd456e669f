"""Scores of texts under a class-based bigram model of their words.

Words have classes, and P(word | word before) is P(class | class before) times
P(word | class). Exchange clustering puts words into classes in two steps. The
``frequent`` most frequent words and, for all others, the forms of their endings
are units whose pairs the model's size bounds; they are exchanged one by one on
the driver, which fixes the classes. Then every word that training texts hold
``least_count`` times is exchanged by itself, in rounds that are Spark jobs: the
counts of the classes around it meet in its hash bucket, all words are moved
against the same class tables, and the tables are counted anew. How many words
that are grows with the corpus, and neither they nor their counts leave the
buckets and batches; class tables alone are sent to the tasks. Rarer and unknown
words keep the class of their ending.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfvec.llm import batches as B
from shelfvec.sources.scratch import drop_stored, materialize

ENDINGS = 512
#: The token after each text's words. No word has a space.
END = b" "
BUCKET_BYTES = 64 << 20
#: Words of a bucket whose classes are chosen at a time.
CHUNK = 4096


@dataclass(frozen=True)
class ClassModel:
    #: Words that fix the classes: so many at most, each of that share of all tokens at least.
    frequent: int = 1500
    frequent_share: float = 2e-5
    #: Training tokens from which on any other word is exchanged by itself.
    least_count: int = 10
    classes: int = 48
    rounds: int = 5
    #: Rounds of exchange over all words of that count, one at least.
    wide_rounds: int = 1
    add: float = 0.1
    prior: float = 1.0


def is_held_out(doc_id: int | None, modulus: int = 10, remainder: int = 0) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == remainder


def ending_of(data: bytes) -> int:
    """Number of a word's form: its last two letters and what comes after them."""
    if data == END:
        return 0
    word = data.decode()
    bare = word.rstrip(".,;:!?\"')»|")
    rest = word[len(bare) :][:1]
    kind = "d" if any(c.isdigit() for c in bare) else "s" if not bare.isalpha() else "w"
    return 1 + zlib.crc32(f"{kind} {bare[-2:]} {rest}".encode()) % (ENDINGS - 1)


def words(data: bytes) -> list[bytes]:
    """Words of UTF-8 text after A-Z went to lower case.

    The white space that bytes know is the six characters that part words here.
    """
    return data.lower().split()


@dataclass(frozen=True)
class Tokens:
    """Texts of a batch, one after another, as numbers of its distinct words; END is number 0.

    The other words are numbered from the most frequent on and the numbers are held
    byte by byte, first bytes first, which compresses to half.
    """

    planes: np.ndarray
    lengths: np.ndarray
    keys: np.ndarray
    endings: np.ndarray

    @property
    def flat(self) -> np.ndarray:
        return np.ascontiguousarray(self.planes.T).view("<i4").ravel()

    def each(self) -> list[np.ndarray]:
        return np.split(self.flat, np.cumsum(self.lengths)[:-1])

    def in_training(self, ids: list) -> np.ndarray:
        """The tokens of texts that are not held out."""
        return self.flat[np.repeat([not is_held_out(i) for i in ids], self.lengths)]


def tokens_of(texts: list[bytes]) -> Tokens:
    import xxhash

    numbers: dict[bytes, int] = {END: 0}
    new = numbers.setdefault
    parts = []
    for data in texts:
        found = [new(w, len(numbers)) for w in words(data)]
        found.append(0)
        parts.append(np.array(found, dtype="i4"))
    flat = np.concatenate(parts)
    times = np.bincount(flat)
    times[0] = len(flat) + 1
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(order), dtype="<i4")
    rank[order] = np.arange(len(order))
    digest = xxhash.xxh3_64_intdigest
    return Tokens(
        np.ascontiguousarray(rank[flat].view("u1").reshape(-1, 4).T),
        np.array([len(x) for x in parts]),
        np.array([digest(w) for w in numbers], dtype="u8")[order],
        np.array([ending_of(w) for w in numbers], dtype="u2")[order],
    )


def _asked(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of its keys, in order."""
    if not len(keys):
        return
    bucket = B.bucket_of(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for at in np.split(order, cuts):
        yield int(bucket[at[0]]), at


def exchange_classes(pairs: np.ndarray, model: ClassModel) -> np.ndarray:
    """A class for each unit, moving units one by one to where the likelihood is best.

    ``pairs[u, v]`` counts v after u. The likelihood of the classes is
    sum n log n over pairs of classes, less that over classes before and after.
    """
    units = len(pairs)
    total = pairs.sum(axis=0) + pairs.sum(axis=1)
    order = np.argsort(-total, kind="stable")
    k = min(model.classes, units)
    own = np.empty(units, dtype="int64")
    own[order] = np.arange(units) % k

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))

    onto = np.zeros((units, k))
    onto[np.arange(units), own] = 1
    table = onto.T @ pairs @ onto
    for _ in range(model.rounds):
        moved = 0
        for u in order:
            if not total[u]:
                continue
            a = own[u]
            after = np.bincount(own, pairs[u], k)
            before = np.bincount(own, pairs[:, u], k)
            self_pair = pairs[u, u]
            after[a] -= self_pair
            before[a] -= self_pair
            table[a] -= after
            table[:, a] -= before
            table[a, a] -= self_pair
            rows, columns = table.sum(axis=1), table.sum(axis=0)
            # Change of sum n log n if u joins each class: its row, its column, and where they cross.
            row = f(table + after) - f(table)
            column = f(table.T + before) - f(table.T)
            diagonal = np.diag(table)
            gain = row.sum(axis=1) - np.diag(row) + column.sum(axis=1) - np.diag(column)
            gain += f(diagonal + after + before + self_pair) - f(diagonal)
            gain -= f(rows + after.sum() + self_pair) - f(rows)
            gain -= f(columns + before.sum() + self_pair) - f(columns)
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            own[u] = b
            table[b] += after
            table[:, b] += before
            table[b, b] += self_pair
        if not moved:
            break
    return own


def likelihood(table: np.ndarray) -> float:
    """Log-likelihood of the classes with these pair counts, but for a constant of the words."""

    def f(x: np.ndarray) -> float:
        return float((x * np.log(np.maximum(x, 1))).sum())

    return f(table) - f(table.sum(axis=0)) - f(table.sum(axis=1))


def best_classes(around: np.ndarray, table: np.ndarray, prior: float = 1.0) -> np.ndarray:
    """The class that makes each word's neighbours and itself likeliest; of equals the least.

    ``around[w]`` counts the classes before the word, then those after it;
    ``table[a, b]`` counts class b after a and is the same for all words.
    """
    k = len(table)
    shares = (table.sum(axis=0) + prior / k) / (table.sum() + prior)
    step = np.log((table + prior * shares) / (table.sum(axis=1, keepdims=True) + prior))
    size = np.log(table.sum(axis=0) + prior)
    own = np.empty(len(around), dtype="i2")
    for at in range(0, len(around), CHUNK):
        before, after = np.hsplit(around[at : at + CHUNK].astype("f8"), 2)
        times = np.maximum(before.sum(axis=1), after.sum(axis=1))
        gain = before @ step + after @ step.T - times[:, None] * size
        own[at : at + CHUNK] = gain.argmax(axis=1)
    return own


def score_texts(docs: DataFrame, model: ClassModel | None = None) -> DataFrame:
    """Base and class-model scores of every whole text of ``doc_id, text``.

    Texts whose id is held out teach nothing. A null text is empty and has the
    end token alone; a null id is not held out. Repeated rows count as often as
    they stand. An empty table gives an empty table. Other columns are not read.
    """
    rule = model or ClassModel()
    spark = docs.sparkSession
    packed = B.pack_documents(docs, prepare=tokens_of)
    buckets = B.bucket_count(packed, BUCKET_BYTES)

    def questions(ids: list, tokens: Tokens, _: dict) -> Iterator[tuple[int, object]]:
        counts = np.bincount(tokens.in_training(ids), minlength=len(tokens.keys))
        for bucket, at in _asked(tokens.keys, buckets):
            yield bucket, (tokens.keys[at], counts[at].astype("u4"), tokens.endings[at])

    def respond(asked: list) -> tuple[list, object]:
        keys = np.concatenate([q[0] for q in asked])
        distinct, first, at = np.unique(keys, return_index=True, return_inverse=True)
        totals = np.bincount(at, np.concatenate([q[1] for q in asked])).astype("int64")
        endings = np.concatenate([q[2] for q in asked])[first]
        known = totals > 0
        rare = known & (totals < rule.least_count)
        top = np.argsort(-totals, kind="stable")[: rule.frequent]
        top = top[known[top]]
        found = (
            np.bincount(endings[rare], minlength=ENDINGS),
            np.bincount(endings[rare], totals[rare], ENDINGS).astype("int64"),
            np.bincount(endings[known], minlength=ENDINGS),
            np.bincount(endings, totals, ENDINGS).astype("int64"),
            distinct[top],
            totals[top],
            endings[top],
        )
        cuts = np.cumsum([len(q[0]) for q in asked])[:-1]
        return np.split(totals[at], cuts), found

    counted = B.answer(B.ask(packed, questions), buckets, respond, "word-counts")
    state = materialize(B.with_answers(packed, counted).select("batch", "load", "answers"), "counted")
    # The loads stand in ``state`` now.
    drop_stored(packed)

    # By ending, the numbers of distinct words and of tokens, rare and all; then the frequent words.
    names = ("rare_distinct", "rare_tokens", "distinct", "tokens")
    sum_schema = T.StructType([T.StructField(n, T.LongType()) for n in ("ending", *names)])
    sums = B.findings(
        counted, sum_schema, lambda x: [pa.array(np.arange(ENDINGS)), *(pa.array(v) for v in x[:4])]
    )
    distinct, tokens = np.zeros(ENDINGS), np.zeros(ENDINGS)
    n_all = v_all = 0
    for row in sums.groupBy("ending").agg(*(F.sum(n).alias(n) for n in names)).collect():
        distinct[row["ending"]], tokens[row["ending"]] = row["rare_distinct"], row["rare_tokens"]
        n_all, v_all = n_all + row["tokens"], v_all + row["distinct"]
    least = max(1, int(n_all * rule.frequent_share))

    def frequent(x: tuple) -> list[pa.Array]:
        # The share bounds how many words all buckets can name together.
        often = x[5] >= least
        return [pa.array(v[often]) for v in (x[4].view("i8"), x[5], x[6].astype("int64"))]

    top_schema = T.StructType([T.StructField(n, T.LongType()) for n in ("key", "total", "ending")])
    tops = B.findings(counted, top_schema, frequent)
    top = tops.orderBy(F.desc("total"), "key").limit(rule.frequent).collect()
    drop_stored(counted)
    for row in top:
        if row["total"] < rule.least_count:
            distinct[row["ending"]] -= 1
            tokens[row["ending"]] -= row["total"]
    keys = np.array([r["key"] for r in top], dtype="i8").view("u8")
    order = np.argsort(keys)
    keys, key_units = keys[order], order.astype("int64")
    units = len(top) + ENDINGS
    unit_distinct = np.concatenate([np.ones(len(top)), distinct])
    unit_tokens = np.concatenate([[float(r["total"]) for r in top], tokens])

    def units_of(tokens: Tokens) -> np.ndarray:
        out = tokens.endings.astype("int64") + len(keys)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, tokens.keys), len(keys) - 1)
            same = keys[at] == tokens.keys
            out[same] = key_units[at[same]]
        return out

    pair_schema = T.StructType([T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())])
    pair_buckets = max(1, min(buckets, units * units >> 18))

    def training_line(ids: list, tokens: Tokens, value: np.ndarray) -> np.ndarray:
        """Training texts one after another: each begins after the end token of the one before it."""
        found = tokens.in_training(ids)
        return value[np.concatenate([[0], found])] if len(found) else value[:0]

    def pair_questions(ids: list, tokens: Tokens, _: dict) -> Iterator[tuple[int, object]]:
        line = training_line(ids, tokens, units_of(tokens))
        pairs, times = np.unique(line[:-1] * units + line[1:], return_counts=True)
        bucket = pairs % pair_buckets
        for b in range(pair_buckets):
            mine = bucket == b
            if mine.any():
                yield b, (pairs[mine], times[mine])

    def pair_sums(asked: list) -> tuple[list, object]:
        pairs, at = np.unique(np.concatenate([q[0] for q in asked]), return_inverse=True)
        return [None] * len(asked), (pairs, np.bincount(at, np.concatenate([q[1] for q in asked])).astype("int64"))

    paired = B.answer(B.ask(state, pair_questions), pair_buckets, pair_sums, "unit-pairs")
    unit_pairs = np.zeros((units, units), dtype="f8")
    # At most units squared numbers, which the model's size bounds.
    found = B.findings(paired, pair_schema, lambda x: [pa.array(x[0]), pa.array(x[1])]).toArrow()
    unit_pairs.ravel()[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    own = exchange_classes(unit_pairs, rule)
    k = int(own.max()) + 1
    onto = np.zeros((units, k))
    onto[np.arange(units), own] = 1
    table = onto.T @ unit_pairs @ onto

    def totals_of(tokens: Tokens, answers: dict) -> np.ndarray:
        totals = np.zeros(len(tokens.keys), dtype="int64")
        for bucket, at in _asked(tokens.keys, buckets):
            totals[at] = answers[bucket]
        return totals

    def wide_words(tokens: Tokens, totals: np.ndarray) -> np.ndarray:
        """Places of words that are exchanged by themselves."""
        return np.flatnonzero((units_of(tokens) >= len(keys)) & (totals >= rule.least_count))

    def classes_of(tokens: Tokens, totals: np.ndarray, answers: dict) -> np.ndarray:
        """Each word's class: its own, or before the first round and for rare words its ending's."""
        out = own[units_of(tokens)]
        wide = wide_words(tokens, totals)
        for bucket, at in _asked(tokens.keys[wide], buckets):
            if bucket + buckets in answers:
                out[wide[at]] = answers[bucket + buckets]
        return out

    def neighbours(ids: list, tokens: Tokens, answers: dict) -> Iterator[tuple[int, object]]:
        totals = totals_of(tokens, answers)
        wide = wide_words(tokens, totals)
        asked = list(_asked(tokens.keys[wide], buckets))
        if not asked:
            return
        # Numbers of the words bucket by bucket, so that a bucket's codes are one run.
        wide = wide[np.concatenate([at for _, at in asked])]
        number = np.full(len(tokens.keys), -1, dtype="int64")
        number[wide] = np.arange(len(wide))
        line = training_line(ids, tokens, number)
        classes = training_line(ids, tokens, classes_of(tokens, totals, answers))
        left, right = line[:-1], line[1:]
        # A word beside itself tells nothing of its class.
        behind, ahead = (right >= 0) & (left != right), (left >= 0) & (left != right)
        codes = np.concatenate(
            [right[behind] * (2 * k) + classes[:-1][behind], left[ahead] * (2 * k) + k + classes[1:][ahead]]
        )
        codes, times = np.unique(codes, return_counts=True)
        start = 0
        for bucket, at in asked:
            mine = wide[start : start + len(at)]
            low, high = np.searchsorted(codes, [start * 2 * k, (start + len(at)) * 2 * k])
            steps = np.diff(codes[low:high], prepend=start * 2 * k).astype("u4")
            yield bucket, (tokens.keys[mine], totals[mine], steps, times[low:high].astype("u4"))
            start += len(at)

    def moved(table: np.ndarray) -> object:
        def move(asked: list) -> tuple[list, object]:
            words, first, at = np.unique(
                np.concatenate([q[0] for q in asked]), return_index=True, return_inverse=True
            )
            totals = np.concatenate([q[1] for q in asked])[first]
            around = np.zeros(len(words) * 2 * k, dtype="f4")
            places = np.split(at, np.cumsum([len(q[0]) for q in asked])[:-1])
            for (_, _, steps, times), place in zip(asked, places, strict=True):
                word, slot = np.divmod(np.cumsum(steps, dtype="int64"), 2 * k)
                around[place[word] * (2 * k) + slot] += times
            chosen = best_classes(around.reshape(-1, 2 * k), table, rule.prior)
            found = np.bincount(chosen, minlength=k), np.bincount(chosen, totals, k).astype("int64")
            return [chosen[place] for place in places], found

        return move

    def pairs_of_classes(ids: list, tokens: Tokens, answers: dict) -> list[pa.Array]:
        line = training_line(ids, tokens, classes_of(tokens, totals_of(tokens, answers), answers))
        times = np.bincount(line[:-1] * k + line[1:], minlength=k * k)
        pairs = np.flatnonzero(times)
        return [pa.array(pairs), pa.array(times[pairs])]

    class_schema = T.StructType([T.StructField(n, T.LongType()) for n in ("class", "distinct", "tokens")])
    class_tokens, class_words = onto.T @ unit_tokens, onto.T @ unit_distinct
    wide_tokens, wide_distinct = np.zeros(k), np.zeros(k)
    best = -np.inf
    for _ in range(rule.wide_rounds):
        chosen = B.answer(B.ask(state, neighbours), buckets, moved(table), "classes")
        mine = (
            chosen.groupBy("batch")
            .agg(F.collect_list(F.struct((F.col("bucket") + buckets).alias("bucket"), "answer")).alias("classes"))
        )
        counts = F.filter("answers", lambda x: x["bucket"] < buckets)
        both = F.concat(counts, F.coalesce("classes", F.array().cast(mine.schema["classes"].dataType)))
        after = materialize(
            state.join(mine, "batch", "left").select("batch", "load", both.alias("answers")), "classed"
        )
        new = np.zeros((k, k))
        sums = B.map_documents(after, pair_schema, pairs_of_classes).groupBy("pair").agg(F.sum("n").alias("n"))
        for row in sums.collect():
            new.ravel()[row["pair"]] = row["n"]
        # The first round always holds: it gives words classes of their own. Later ones must gain.
        if likelihood(new) <= best:
            break
        drop_stored(state)
        state, table, best = after, new, likelihood(new)
        wide_distinct, wide_tokens = np.zeros(k), np.zeros(k)
        sums = B.findings(chosen, class_schema, lambda x: [pa.array(np.arange(k)), pa.array(x[0]), pa.array(x[1])])
        for row in sums.groupBy("class").agg(F.sum("distinct").alias("d"), F.sum("tokens").alias("n")).collect():
            wide_distinct[row["class"]], wide_tokens[row["class"]] = row["d"], row["n"]
    class_tokens, class_words = class_tokens + wide_tokens, class_words + wide_distinct

    shares = (table.sum(axis=0) + rule.prior / k) / (table.sum() + rule.prior)
    step = np.log10((table + rule.prior * shares) / (table.sum(axis=1, keepdims=True) + rule.prior))
    emit_floor = np.log10(class_tokens + rule.add * (class_words + 1))
    base_floor = np.log10(n_all + rule.add * (v_all + 1))
    sent = spark.sparkContext.broadcast((step, emit_floor))
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("held_out", T.BooleanType()),
            *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")),
            *(T.StructField(n, T.DoubleType()) for n in ("base_score", "score")),
        ]
    )

    def scored(ids: list, tokens: Tokens, answers: dict) -> list[pa.Array]:
        step, emit_floor = sent.value
        counts = totals_of(tokens, answers)
        classes = classes_of(tokens, counts, answers)
        weight = np.log10(counts + rule.add)
        base = weight - base_floor
        emit = weight - emit_floor[classes]
        rows = []
        for doc_id, found in zip(ids, tokens.each(), strict=True):
            line = classes[found]
            steps = step[np.concatenate([classes[:1], line[:-1]]), line]
            rows.append(
                (
                    doc_id,
                    is_held_out(doc_id),
                    len(found),
                    int((counts[found] > 0).sum()),
                    n_all,
                    float(base[found].sum()),
                    float(emit[found].sum() + steps.sum()),
                )
            )
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]

    return B.map_documents(state, schema, scored)
