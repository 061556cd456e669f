"""Repair of conversations and their prefix trie, against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from shelfvec.llm import conversation_repair as R
from shelfvec.llm import prefix_trie as P

SHAPE = re.compile(r"(s?(ua)+)?")


def all_repairs(initials, faults):
    """Every edit sequence with up to two inserts in each gap, its price and result."""
    n = len(initials)
    per_row = [["D"] if f in (R.BLANK, R.DUPLICATE) else ["D", "K", "Ru", "Ra"] for f in faults]
    for rows in itertools.product(*per_row):
        for gaps in itertools.product(["", "Iu", "Ia", "IuIa", "IaIu"], repeat=n + 1):
            price, shape, audit = 0, "", ""
            for i in range(n + 1):
                price += 5 * gaps[i].count("I")
                shape += gaps[i].replace("I", "")
                audit += "I" * gaps[i].count("I")
                if i == n:
                    break
                edit = rows[i]
                audit += edit[0]
                price += {"D": 2, "K": 0, "R": 1}[edit[0]] + 5 * (faults[i] == R.CUT and edit != "D")
                shape += "" if edit == "D" else initials[i] if edit == "K" else edit[1]
            if SHAPE.fullmatch(shape):
                yield price, audit


def test_search_equals_every_sequence_of_edits():
    draw = random.Random(1)
    for n in range(4):
        for _ in range(25):
            initials = [draw.choice("suax ") for _ in range(n)]
            faults = [draw.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
            assert R.search(initials, faults) == min(all_repairs(initials, faults)), (initials, faults)


def plain_best(initials, faults):
    """Best (price, audit) by going over the turns with one best prefix per phase."""
    states = {R.START: (0, "")}
    for i in range(len(initials) + 1):
        for _ in range(3):
            for phase, (cost, audit) in list(states.items()):
                to, new = R.NEXT[phase], (cost + 5, audit + "I")
                states[to] = min(states.get(to, new), new)
        if i == len(initials):
            break
        after = {}
        for phase, (cost, audit) in states.items():
            for name, price, to in R.edits(phase, faults[i], initials[i]):
                new = (cost + price, audit + name)
                after[to] = min(after.get(to, new), new)
        states = after
    return min(states[p] for p in R.ENDS if p in states)


def test_search_and_segments_equal_the_plain_recursion_on_long_conversations():
    draw = random.Random(2)
    for _ in range(60):
        n = draw.randint(0, 80)
        initials = [draw.choice("suuaa") if draw.random() < 0.4 else "ua"[i % 2] for i in range(n)]
        faults = [draw.choice([1, 2, 3]) if draw.random() < 0.2 else 0 for _ in range(n)]
        want = plain_best(initials, faults)
        assert R.search(initials, faults) == want
        size = draw.randint(1, 12)
        cuts = list(range(0, n, size))
        parts = [R.segment_paths(initials[c : c + size], faults[c : c + size], c == 0, c == cuts[-1]) for c in cuts]
        if parts:
            price, way = R.chain([paths for paths, _ in parts])
            assert (price, "".join(audits[rank] for (_, rank), (_, audits) in zip(way, parts, strict=True))) == want


@pytest.mark.parametrize("initials", ["s" * 3000, "u" * 3000, "a" * 3000, "us" * 1500, "x" * 500, "ua" * 2000])
def test_search_ends_on_one_sided_conversations(initials):
    faults = [R.CUT if i % 7 == 3 else R.SOUND for i in range(len(initials))]
    assert R.search(list(initials), faults) == plain_best(initials, faults)


def crc(text):
    return zlib.crc32(text.encode())


def shown(value):
    return " " if value is None else str(value)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def plain_digests(rows):
    """The contract, row by row in Python."""
    groups = {}
    for conv, turn, role, text in rows:
        role, text = shown(role), shown(text)
        kind = crc(f"{shown(conv)}:{shown(turn)}") % 20
        mine = groups.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, mine in groups.items():
        mine = ordered(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, seen = [], set()
        for _, _, role, text in mine:
            letters = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append(1 if not letters else 2 if (role, text) in seen else 3 if letters[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = plain_best(initials, faults)
        lines, at, last = [], 0, ""
        for edit in audit:
            if edit in "IR":
                role = "assistant" if last == "u" else "user"
                lines.append(role + ":" + ("" if edit == "I" else mine[at][3]))
                last = role[0]
            elif edit == "K":
                lines.append(mine[at][2] + ":" + mine[at][3])
                last = mine[at][2][0]
            at += edit != "I"
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *[faults.count(f) for f in (1, 2, 3)], illegal, cost, audit, digest)
    return out


def awkward_rows(seed, convs=60, most=12):
    draw = random.Random(seed)
    texts = ["Hello.", "Why?", "no end", "", " \t", "Yes!  \n", "Done.", "x" * 5000 + ".", None, "日本。", "é.", "Hello.", "\xa0"]
    rows = []
    for c in range(convs):
        for t in range(draw.randint(1, most)):
            role = ("user", "assistant")[t % 2] if draw.random() < 0.8 else draw.choice(["system", "user", "admin", "", None, "tool"])
            text = draw.choice(texts) if draw.random() < 0.4 else f"Turn {draw.randrange(10**6)}."
            rows.append((c, t * draw.choice([1, 1, 1, 2]) if draw.random() < 0.95 else None, role, text))
    rows += [rows[0], rows[0], rows[5], (None, 1, "user", "Lost."), (None, None, "assistant", "Lost?"), (None, 2, None, None)]
    rows += [(-7, -(10**12), "user", "Early."), (-7, 3, "assistant", "Late.")]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def by_id(rows):
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("segment", [R.SEGMENT, 5])
def test_repair_digests_equal_the_contract_row_by_row(spark, segment):
    rows = awkward_rows(3)
    # Long conversations of many segments, with repeats far apart and one that ends without a turn.
    rows += [(1000, i, ("user", "assistant")[i % 2], f"Line {i % 23}.") for i in range(97)]
    rows += [(1001, i, "user", "") for i in range(33)]
    given = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert by_id(R.repair_digests(given, segment).collect()) == plain_digests(rows)


def test_a_conversation_that_loses_all_rows(spark):
    gone = next(c for c in range(1000) if crc(f"{c}:0") % 20 == 0)
    out = R.repair_digests(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)).collect()
    assert by_id(out) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert R.repair_digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repaired_turns_and_other_columns(spark):
    rows = [(1, 0, "system", "Be kind.", "x", 5), (1, 1, "user", "Hi.", "y", 6), (1, 2, "user", "Still there?", "z", 7)]
    df = spark.createDataFrame(rows, "conv string, n long, who string, said string, conv_id string, segment int").drop("conv").withColumnRenamed("segment", "cost")
    out = R.repair_conversations(df, "conv_id", "n", "who", "said").collect()
    assert {r.conv_id: (r.cost, r.audit) for r in out} == {"x": (2, "D"), "y": (2, "D"), "z": (2, "D")}
    whole = df.withColumnRenamed("conv_id", "text").selectExpr("'c' AS conv_id", "*")
    got = R.repair_conversations(whole, "conv_id", "n", "who", "said").first()
    assert (got.cost, got.audit) == (1, "KKR")
    assert [tuple(t) for t in got.repaired] == [("system", "Be kind."), ("user", "Hi."), ("assistant", "Still there?")]
    for segment in (1, 2):
        parts = R.repair_conversations(whole, "conv_id", "n", "who", "said", segment=segment).orderBy("segment").collect()
        assert "".join(p.audit for p in parts) == "KKR" and sum(p.cost for p in parts) == 1
        assert sum([[tuple(t) for t in p.repaired] for p in parts], []) == [tuple(t) for t in got.repaired]


def plain_trie(convs):
    """Nodes by prefix from whole lists of turns."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for prefix, held in members.items():
        under = [p for p in members if p[: len(prefix)] == prefix]
        children = [p for p in under if len(p) == len(prefix) + 1]
        leaves = [p for p in under if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in under)]
        words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        ends = ",".join(str(c) for c in sorted(held) if len(convs[c]) == len(prefix))
        parent = min(members[prefix[:-1]]) if prefix else None
        out.append(
            (min(held), len(prefix), parent, len(held), len(children), len(leaves),
             sum((len(members[p]) - 1) * words(p) for p in under), hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=str)


def plain_rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((conv, turn, role or "", text or ""))
    own = {c: [r[2:] for r in ordered(mine)] for c, mine in own.items()}
    out = {}
    for c, mine in own.items():
        h = crc(str(c)) % 4
        out[c] = own.get(c - c % 20, [])[:h] + mine[h:]
    return out


def trie_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == names
    return sorted((tuple(r) for r in df.collect()), key=str)


def common_rows(seed):
    """Conversations with few distinct turns, so that many share long prefixes."""
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(300), 90):
        for t in range(draw.randint(1, 6)):
            text = draw.choice(["Hi there.", "Go on please.", "", "One two three."]) if draw.random() < 0.8 else f"Own {c} {t}"
            rows.append((c, t, ("user", "assistant")[t % 2], text))
    rows += [(500 + i, t, "user", "Same long talk.") for i in range(40) for t in range(30)]
    rows += [(500, 30, "user", "More."), (None, 0, "user", "Hi there."), (501, None, None, None), (502, None, None, None)]
    rows += [(700, 0, "user", "Twice."), (700, 0, "user", "Twice."), (700, 1, "user", None), (701, 0, "user", "Twice.")]
    rows += [(900, t, "user", f"Alone {t}.") for t in range(200)]
    return rows


@pytest.mark.parametrize("shard", [P.SHARD, 4])
def test_rebuilt_trie_equals_whole_prefixes(spark, shard):
    rows = common_rows(4)
    given = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", depth int, a string").repartition(4)
    assert trie_rows(P.rebuilt_trie(given, shard)) == plain_trie(plain_rebuilt(rows))


def test_trie_without_rebuilding_and_without_rows(spark):
    rows = [r for r in common_rows(6) if r[0] is not None]
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append((r[0], r[1], r[2] or "", r[3] or ""))
    want = plain_trie({c: [r[2:] for r in ordered(mine)] for c, mine in convs.items()})
    renamed = spark.createDataFrame(rows, "c long, t long, r string, x string")
    got = P.prefix_trie(renamed, 16, id_col="c", turn_col="t", role_col="r", text_col="x")
    assert trie_rows(got) == want
    empty = spark.createDataFrame([], SCHEMA)
    assert P.rebuilt_trie(empty).collect() == [] and P.prefix_trie(empty).collect() == []


def test_a_conversation_without_turns_of_its_own_is_a_member_of_the_root(spark):
    # Borrows more turns than its missing base has, and has fewer than it gives up.
    c = next(c for c in range(1, 2000) if c % 20 and crc(str(c)) % 4 == 3)
    out = P.rebuilt_trie(spark.createDataFrame([(c, 0, "user", "Lost.")], SCHEMA)).collect()
    digest = hashlib.sha256(str(c).encode()).hexdigest()
    assert [tuple(r) for r in out] == [(c, 0, None, 1, 0, 1, 0, digest)]


def test_vertical_index_children_are_intersections():
    a, b, c = (1, 1, 2), (2, 2, 3), (3, 3, 1)
    index = P.VerticalIndex([10, 20, 30, 40], [[a, b], [a, c], [a, b], [b]], [2, 2, 2, 1])
    assert [(turn, list(P.bits_of(m))) for turn, m in index.children(0b1111, 0)] == [(a, [0, 1, 2]), (b, [3])]
    assert [(turn, list(P.bits_of(m))) for turn, m in index.children(0b0111, 1)] == [(b, [0, 2]), (c, [1])]
    assert [n[2] for n in index.nodes()] == [0, 1, 2, 2, 1]
