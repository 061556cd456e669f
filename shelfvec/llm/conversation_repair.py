"""Repair of damaged conversations by depth-first branch and bound.

A repaired conversation is empty or an optional system turn followed by pairs
of a user's and an assistant's turn. Turns may be kept, given another role,
deleted or inserted, each at a price; the cheapest sequence of edits is wanted
and, among equally cheap ones, the one whose initials are least in ASCII.

A prefix of edits stands at a node (turns used, phase): the phase says what
the turns kept so far end in. ``search`` walks prefixes depth first with an
explicit stack. It drops a prefix when

* its cost plus the suffix's lower bound exceeds the incumbent's cost, or equals
  it while the prefix is already greater than the incumbent's audit;
* the node's dominance table holds a prefix that is cheaper, or as cheap and
  less in ASCII: whatever follows would follow that one too.

When the stack is empty the incumbent is proved the best. The bound solves a
relaxed problem from the end backwards, in which a conversation may also stop
after its system turn. Prefixes are linked lists that share their heads, so
memory grows with the turns, and comparing two only reads what they differ in.

A conversation of more than ``segment`` rows is cut into segments of so many
rows, wherever they lie. Each is searched by itself from every phase it can be
entered in to every phase it can be left in. A chain of these few prices and of
the audits' ranks picks the phases between segments; only then is the text read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfvec.llm.arrow_rows import running_digests, runs
from shelfvec.operators.joins import lookup_join
from shelfvec.operators.numbering import with_positions
from shelfvec.sources.scratch import materialize
from shelfvec.sources.shipping import ensure_shipped

# Prices of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: Rows of a conversation that one search takes at most.
SEGMENT = 4096

SOUND, BLANK, DUPLICATE, CUT = range(4)
#: What stands so far: nothing, a lone system turn, ends in a user's turn, ends in an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
PHASES = (START, SYSTEM, USER, ASSISTANT)
#: Phase after one more user's or assistant's turn, whichever is due.
NEXT = (USER, USER, ASSISTANT, USER)
#: Phase after a kept turn, by its role's initial; others cannot be kept.
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The lower bound takes the phases after a system and an assistant's turn for one.
NEEDS = (0, 1, 2, 1)
ENDS = (START, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 60

TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def edits(phase: int, fault: int, initial: str) -> Iterator[tuple[str, int, int]]:
    """Initial, price and next phase of what can be done with a turn, in ASCII order."""
    yield "D", DELETE, phase
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED if fault == CUT else 0
    if initial in KEPT[phase]:
        yield "K", more, KEPT[phase][initial]
    yield "R", REROLE + more, NEXT[phase]


def lower_bounds(initials: list[str], faults: list[int], goals: tuple[int, ...], last: bool) -> list[list[int]]:
    """For each suffix and need the least price of the relaxed problem."""
    at_end = [FAR] * 3
    for goal in goals:
        at_end[NEEDS[goal]] = 0

    def with_inserts(own: list[int]) -> list[int]:
        start, user, assistant = own
        return [
            min(start, INSERT + assistant, 2 * INSERT + user),
            min(user, INSERT + assistant),
            min(assistant, INSERT + user),
        ]

    bounds = [with_inserts(at_end) if last else at_end]
    for initial, fault in zip(reversed(initials), reversed(faults), strict=True):
        after = bounds[-1]
        own = [FAR] * 3
        for phase in (START, ASSISTANT, USER):
            own[NEEDS[phase]] = min(price + after[NEEDS[to]] for _, price, to in edits(phase, fault, initial))
        bounds.append(with_inserts(own))
    bounds.reverse()
    return bounds


def less(a: tuple, b: tuple) -> bool:
    """Whether the first of two different prefixes is less in ASCII; a prefix is less than what extends it."""
    left = right = ""
    while a is not b:
        if a[2] >= b[2]:
            deeper, left = a, a[1]
            if a[2] == b[2]:
                right, b = b[1], b[0]
            a = deeper[0]
        else:
            right, b = b[1], b[0]
    return left < right


def audit_of(node: tuple) -> str:
    out = []
    while node[0] is not None:
        out.append(node[1])
        node = node[0]
    return "".join(reversed(out))


def search(
    initials: list[str], faults: list[int], entry: int = START, goals: tuple[int, ...] = ENDS, last: bool = True
) -> tuple[int, str] | None:
    """Price and audit of the best edits from one phase to one of the goals; None without any.

    Inserts stand before a turn, at the end only if these turns are the ``last``.
    """
    bounds = lower_bounds(initials, faults, goals, last)
    end = len(initials)
    best: tuple[int, tuple] | None = None
    reached: dict[int, tuple[int, tuple]] = {}
    # (cost, turns used, phase, prefix); a prefix is (its head, last initial, length).
    stack = [(0, 0, entry, (None, "", 0))]
    while stack:
        cost, at, phase, prefix = stack.pop()
        bound = cost + bounds[at][NEEDS[phase]]
        if bound >= FAR or best and (bound > best[0] or bound == best[0] and not less(prefix, best[1])):
            continue
        node = 4 * at + phase
        known = reached.get(node)
        if known and (known[0] < cost or known[0] == cost and not less(prefix, known[1])):
            continue
        reached[node] = cost, prefix
        if at == end and phase in goals:
            best = cost, prefix
            continue
        steps = []
        if at < end:
            steps = [(price, at + 1, to, name) for name, price, to in edits(phase, faults[at], initials[at])]
        if at < end or last:
            steps.append((INSERT, at, NEXT[phase], "I"))
        # The most promising is popped first, of equals the least in ASCII.
        steps.sort(key=lambda s: (s[0] + bounds[s[1]][NEEDS[s[2]]], s[3]), reverse=True)
        length = prefix[2] + 1
        stack += [(cost + price, used, to, (prefix, name, length)) for price, used, to, name in steps]
    return best and (best[0], audit_of(best[1]))


def apply_audit(audit: str, roles: list[str], texts: list[str], phase: int = START) -> list[tuple[str, str]]:
    """The repaired turns."""
    out = []
    at = 0
    for edit in audit:
        if edit in "IR":
            phase = NEXT[phase]
            out.append((NAMES[phase], "" if edit == "I" else texts[at]))
        elif edit == "K":
            phase = KEPT[phase][roles[at][:1]]
            out.append((roles[at], texts[at]))
        at += edit != "I"
    return out


def first_faults(blank: list[bool], cut: list[bool], seen: list[bool]) -> list[int]:
    return [BLANK if b else DUPLICATE if d else CUT if c else SOUND for b, d, c in zip(blank, seen, cut, strict=True)]


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def checked_turns(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Turns under fixed names, with the flags that a turn has by itself; nulls are one space."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    shown = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    return (
        turns.select(
            F.col(id_col).alias("id"),
            F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("")).alias("conv"),
            F.col(turn_col).cast("long").alias("turn"),
            role.alias("role"),
            text.alias("text"),
        )
        .withColumn("blank", shown == "")
        .withColumn("cut", ~F.endswith(shown, F.lit(".")) & ~F.endswith(shown, F.lit("!")) & ~F.endswith(shown, F.lit("?")))
    )


#: Ascending order puts nulls first.
ORDER = ["turn", "role", "text"]


def _summary(id_type: T.DataType) -> T.StructType:
    schema = T.StructType([T.StructField("id", id_type), T.StructField("conv", T.StringType()), T.StructField("segment", T.LongType())])
    for name in COUNTS:
        schema = schema.add(T.StructField(name, T.LongType()))
    return schema.add("audit", T.StringType()).add("repaired", T.ArrayType(TURN))


def _turn_array(rows: list[list[tuple[str, str]]]) -> pa.Array:
    flat = [turn for turns in rows for turn in turns]
    offsets = [0]
    for turns in rows:
        offsets.append(offsets[-1] + len(turns))
    values = pa.StructArray.from_arrays(
        [pa.array([r for r, _ in flat], pa.string()), pa.array([t for _, t in flat], pa.string())], ["role", "text"]
    )
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def gap_count(first: int | None, last: int | None, distinct: int) -> int:
    return 0 if first is None else last - first + 1 - distinct


def repair_whole(checked: DataFrame) -> DataFrame:
    """One row per conversation; each is held in one task as a whole."""
    ensure_shipped(checked.sparkSession)
    schema = _summary(checked.schema["id"].dataType)
    names = ["id", "turn", "role", "text", "blank", "cut"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        kind, held = None, 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            arrays = [pa.array(columns[0], kind), pa.array(columns[1], pa.string()), pa.array([0] * len(done), pa.int64())]
            arrays += [pa.array(c, pa.int64()) for c in columns[2:8]]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(columns[8], pa.string()), _turn_array(columns[9])], names=schema.names)

        for conv, rows in runs(batches, ["conv"], names):
            kind = rows["id"].type
            ids, turns, roles, texts, blank, cut = (rows[n].to_pylist() for n in names)
            known: set[tuple[str, str]] = set()
            seen = []
            for turn in zip(roles, texts, strict=True):
                seen.append(turn in known)
                known.add(turn)
            faults = first_faults(blank, cut, seen)
            initials = [r[:1] for r in roles]
            cost, audit = search(initials, faults)
            numbers = [t for t in turns if t is not None]
            gaps = gap_count(numbers[0], numbers[-1], len(set(numbers))) if numbers else 0
            counts = [faults.count(f) for f in (BLANK, DUPLICATE, CUT)]
            done.append(
                (ids[0], conv[0], gaps, *counts, illegal_pairs(initials), cost, audit, apply_audit(audit, roles, texts))
            )
            held += len(roles)
            if held >= 4096:
                yield flush()
                done, held = [], 0
        if done:
            yield flush()

    ordered = checked.repartition("conv").sortWithinPartitions("conv", *ORDER)
    return ordered.mapInArrow(run, schema)


PATH = T.StructType(
    [
        T.StructField("entry", T.IntegerType()),
        T.StructField("exit", T.IntegerType()),
        T.StructField("cost", T.LongType()),
        T.StructField("rank", T.IntegerType()),
    ]
)
TABLE = T.StructType(
    [
        T.StructField("conv", T.StringType()),
        T.StructField("segment", T.LongType()),
        *[T.StructField(n, T.LongType()) for n in ("blank", "duplicate", "truncated", "illegal", "first_turn", "last_turn", "n_turns")],
        T.StructField("first_initial", T.StringType()),
        T.StructField("last_initial", T.StringType()),
        T.StructField("paths", T.ArrayType(PATH)),
        T.StructField("audits", T.ArrayType(T.StringType())),
    ]
)
CHOICE = T.StructType(
    [T.StructField("conv", T.StringType())]
    + [T.StructField(n, T.LongType()) for n in ("segment", "entry", "rank", *COUNTS)]
)
#: The exit of a last segment.
DONE = 4


def segment_paths(initials: list[str], faults: list[int], first: bool, last: bool) -> tuple[list[tuple], list[str]]:
    """Best edits from each phase to each, as (entry, exit, cost, rank of the audit), and the audits by rank."""
    found = {}
    for entry in (START,) if first else PHASES:
        for leave, goals in [(DONE, ENDS)] if last else [(p, (p,)) for p in PHASES]:
            best = search(initials, faults, entry, goals, last)
            if best:
                found[entry, leave] = best
    audits = sorted({audit for _, audit in found.values()})
    rank = {audit: i for i, audit in enumerate(audits)}
    return [(*key, cost, rank[audit]) for key, (cost, audit) in found.items()], audits


def chain(segments: list[list[tuple]]) -> tuple[int, list[tuple[int, int]]]:
    """Price of the best way through all segments, and its (entry, rank) in each."""
    reached = {START: (0, (None, 0, 0), None)}
    for paths in segments:
        after: dict[int, tuple] = {}
        for entry, leave, cost, rank in paths:
            if entry not in reached:
                continue
            price, prefix, way = reached[entry]
            node = (prefix, rank, prefix[2] + 1)
            known = after.get(leave)
            if known is None or price + cost < known[0] or price + cost == known[0] and ranked_less(node, known[1]):
                after[leave] = (price + cost, node, (way, entry, rank))
        reached = after
    price, _, way = reached[DONE]
    out = []
    while way is not None:
        out.append((way[1], way[2]))
        way = way[0]
    return price, out[::-1]


def ranked_less(a: tuple, b: tuple) -> bool:
    """``less`` for two chains of ranks through as many segments."""
    left = right = 0
    while a is not b:
        left, right = a[1], b[1]
        a, b = a[0], b[0]
    return left < right


def repair_segments(checked: DataFrame, segment: int) -> DataFrame:
    """One row per segment of a conversation; counts and cost stand in its first."""
    spark = checked.sparkSession
    ensure_shipped(spark)
    # All copies of a turn are equal, so their order does not matter.
    digest = [F.xxhash64("role", "text"), F.xxhash64("text", "role", F.lit(1))]
    placed = with_positions(checked, ["conv", *ORDER], "place")
    starts = placed.groupBy("conv").agg(F.min("place").alias("start"), F.max("place").alias("final"))
    placed = lookup_join(placed, starts, ["conv"]).withColumn("segment", F.floor((F.col("place") - F.col("start")) / segment))
    placed = materialize(placed, "placed-turns")
    light = placed.select(
        "conv", "segment", "place", "turn", "blank", "cut", F.substring("role", 1, 1).alias("initial"),
        (F.col("segment") == F.floor((F.col("final") - F.col("start")) / segment)).alias("last"),
        digest[0].alias("a"), digest[1].alias("b"),
    )
    known = light.groupBy("conv", "a", "b").agg(F.min("place").alias("earliest"))
    light = lookup_join(light, known, ["conv", "a", "b"]).withColumn("seen", F.col("place") > F.col("earliest"))

    names = ["turn", "blank", "cut", "seen", "initial", "last"]

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, number), rows in runs(batches, ["conv", "segment"], names):
            turns, blank, cut, seen, initials, last = (rows[n].to_pylist() for n in names)
            faults = first_faults(blank, cut, seen)
            paths, audits = segment_paths(initials, faults, number == 0, last[0])
            numbers = [t for t in turns if t is not None]
            row = {
                "conv": conv, "segment": number, "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE),
                "truncated": faults.count(CUT), "illegal": illegal_pairs(initials),
                "first_turn": numbers[0] if numbers else None, "last_turn": numbers[-1] if numbers else None,
                "n_turns": len(set(numbers)), "first_initial": initials[0], "last_initial": initials[-1],
                "paths": [dict(zip(PATH.names, p, strict=True)) for p in paths], "audits": audits,
            }
            yield pa.RecordBatch.from_pylist([row], schema=table_schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    table_schema, choice_schema = to_arrow_schema(TABLE), to_arrow_schema(CHOICE)
    order = ["conv", "segment"]
    solved = light.repartition(*order).sortWithinPartitions(*order, "place").mapInArrow(tables, TABLE)
    solved = materialize(solved, "segment-paths")
    small = [f for f in TABLE.names if f not in ("conv", "audits")]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), rows in runs(batches, ["conv"], small):
            parts = rows.to_pylist()
            price, way = chain([[tuple(p[n] for n in PATH.names) for p in part["paths"]] for part in parts])
            sums = {n: sum(p[n] for p in parts) for n in ("blank", "duplicate", "truncated", "illegal")}
            sums["illegal"] += sum(
                illegal_pairs([p["last_initial"], q["first_initial"]]) for p, q in zip(parts, parts[1:])
            )
            timed = [p for p in parts if p["n_turns"]]
            distinct = sum(p["n_turns"] for p in timed) - sum(p["last_turn"] == q["first_turn"] for p, q in zip(timed, timed[1:]))
            gaps = gap_count(timed[0]["first_turn"], timed[-1]["last_turn"], distinct) if timed else 0
            whole = {"gaps": gaps, "cost": price, **sums}
            rows_ = [
                {"conv": conv, "segment": p["segment"], "entry": entry, "rank": rank, **{n: 0 if i else whole[n] for n in COUNTS}}
                for i, (p, (entry, rank)) in enumerate(zip(parts, way, strict=True))
            ]
            for first in range(0, len(rows_), 4096):
                yield pa.RecordBatch.from_pylist(rows_[first : first + 4096], schema=choice_schema)

    chosen = solved.select("conv", *small).repartition("conv").sortWithinPartitions(*order).mapInArrow(choose, CHOICE)
    chosen = chosen.join(solved.select(*order, "audits"), order)
    chosen = chosen.withColumn("audit", F.element_at("audits", (F.col("rank") + 1).cast("int"))).drop("audits", "rank")
    schema = _summary(checked.schema["id"].dataType)

    def rewrite(rows: pd.DataFrame, choice: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        made = choice.iloc[0]
        turns = apply_audit(made["audit"], rows["role"].tolist(), rows["text"].tolist(), int(made["entry"]))
        out = {n: [made[n]] for n in ("conv", "segment", *COUNTS, "audit")}
        out["id"] = [rows["id"].iloc[0]]
        out["repaired"] = [[{"role": r, "text": t} for r, t in turns]]
        return pd.DataFrame(out)[schema.names]

    both = placed.select("id", *order, "place", "role", "text").groupBy(*order).cogroup(chosen.groupBy(*order))
    return both.applyInPandas(rewrite, schema)


def repair_conversations(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    segment: int = SEGMENT,
) -> DataFrame:
    """``conv_id, segment, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired``.

    One row per conversation, or per ``segment`` rows of a longer one. A longer
    one's audit and repaired turns are those of its segments in order; its
    counts stand in its first segment, the others have zeros.

    Turns go by ``turn``, nulls first, equal ones by role and text. A null role
    or text is one space. Rows without an id are one conversation. Repeated rows
    are duplicates. Other columns are not read, whatever their names. An empty
    table gives an empty table.
    """
    checked = checked_turns(turns, id_col, turn_col, role_col, text_col)
    long = checked.groupBy("conv").agg(F.count("*").alias("n")).where(F.col("n") > segment).select("conv")
    long = materialize(long, "long-conversations")
    if long.isEmpty():
        out = repair_whole(checked)
    else:
        whole = repair_whole(checked.join(long, "conv", "left_anti"))
        out = whole.unionByName(repair_segments(checked.join(long, "conv", "left_semi"), segment))
    return out.withColumnRenamed("id", id_col).drop("conv")


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage that crc32 of ``conv_id:turn`` decides; nulls are one space."""
    number = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(number[0], F.lit(":"), number[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind")).where("_kind <> 0")
    hurt = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        hurt.alias("text"),
        F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    ).drop("_copy")


def lines_of(repaired: Column) -> Column:
    return F.array_join(F.transform(repaired, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def repair_digests(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The registered query: damage, repair, and per original ``conv_id`` counts, audit and digest.

    Conversations that lose all rows have zeros, an empty audit and the empty
    text's digest. Nulls, ties and repeats as in ``repair_conversations``.
    """
    done = repair_conversations(damaged(turns), segment=segment)
    done = done.withColumn("piece", lines_of(F.col("repaired"))).withColumn("empty", F.size("repaired") == 0).drop("repaired")
    done = materialize(done, "repaired")
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    several = materialize(done.where("segment > 0").select(key.alias("key")).distinct(), "in-segments")
    ids = turns.select(key.alias("key"), "conv_id").groupBy("key").agg(F.first("conv_id").alias("conv_id"))
    keyed = done.withColumn("key", key).drop("conv_id")
    sums = [F.col(n) for n in COUNTS]
    if several.isEmpty():
        found = keyed.select("key", *sums, "audit", F.sha2("piece", 256).alias("repaired_sha256"))
    else:
        one = keyed.join(several, "key", "left_anti").select("key", *sums, "audit", F.sha2("piece", 256).alias("repaired_sha256"))
        parts = keyed.join(several, "key", "left_semi")
        audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "audit"))), lambda x: x["audit"]), "")
        many = parts.groupBy("key").agg(*[F.sum(n).alias(n) for n in COUNTS], audit.alias("audit"))
        hashes = running_digests(parts.where("NOT empty").select("key", "segment", "piece"))
        empty = hashlib.sha256().hexdigest()
        many = many.join(hashes, "key", "left").select("key", *sums, "audit", F.coalesce("sha256", F.lit(empty)).alias("repaired_sha256"))
        found = one.unionByName(many)
    nothing = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in COUNTS]
    return ids.join(found, "key", "left").select(
        "conv_id",
        *nothing,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
