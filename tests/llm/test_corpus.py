"""Language, class model, repeats, pages and the registered queries."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from shelfvec.llm import class_lm, extraction, language_id, suffix_dedup
from tests.compare import compare
from tests.llm.conftest import prose, rows_of

SF = "/root/testdata/sf0.001"


def test_language_accuracy_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.held_out_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_awkward_texts(awkward, awkward_texts, nothing):
    got = language_id.held_out_languages(awkward).collect()
    assert len(got) == len(rows_of(awkward_texts))
    for r in got:
        text = awkward_texts[r.doc_id] if r.doc_id is not None else None
        if r.doc_id is not None:
            unknown = not any(c.isalpha() for c in text or "")
            assert (r.lang_pred == "und") == unknown and (r.lang_pred in ("en", "fr", "und"))
            assert r.score == 0 or not unknown
        else:
            assert r.held_out is False
    assert language_id.held_out_languages(nothing).count() == 0


def test_grams_do_not_depend_on_chunks(monkeypatch):
    text = prose(random.Random(1), 500) + " Ünïcödé ǆ 12-34 " + "x" * 50
    whole = language_id.gram_counts(text)
    monkeypatch.setattr(language_id, "CHUNK", 1 << 30)
    assert np.array_equal(language_id.gram_counts(text), whole)
    monkeypatch.setattr(language_id, "CHUNK", 97)
    chunked = language_id.gram_counts(text)
    assert np.abs(chunked - whole).sum() <= 4 * (len(text) // 97 + 1)
    assert language_id.gram_counts("12 34") is None


def test_several_centroids_follow_clusters():
    draw = np.random.default_rng(1)
    centers = np.eye(4, 50)
    vectors = np.concatenate([c + 0.05 * draw.random((40, 50)) for c in centers])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    found, radii = language_id.centroids_of(vectors.astype("f4"), language_id.Training())
    assert sorted((vectors @ found.T).argmax(axis=1)[::40].tolist()) == [0, 1, 2, 3]
    assert (radii > 0.9).all()


def base_truth(rows):
    words = [(r[0], (r[1] or "").encode().lower().split() + [None]) for r in rows]
    counts = Counter()
    for doc_id, found in words:
        if doc_id is None or zlib.crc32(str(doc_id).encode()) % 10:
            counts.update(found)
    total, kinds = sum(counts.values()), len(counts)
    log = lambda w: math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1)))
    return Counter(
        (d, len(f), sum(counts[w] > 0 for w in f), total, round(sum(map(log, f)), 5)) for d, f in words
    )


def test_class_model(awkward, awkward_texts, nothing, monkeypatch):
    monkeypatch.setattr("shelfvec.llm.batches.BATCH_BYTES", 20_000)
    got = class_lm.score_texts(awkward).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == base_truth(rows_of(awkward_texts))
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert class_lm.score_texts(nothing).count() == 0


def test_class_model_is_a_distribution_and_better_than_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = class_lm.score_texts(docs).where("held_out").collect()
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    # One-word texts over a closed vocabulary and one unknown word of each class: shares sum to at most one.
    rows = [(i, w) for i, w in enumerate(["a", "b", "a b", "b a", "a", "c"] * 4)]
    scored = class_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    shares = {texts[r.doc_id]: 10**r.score for r in scored if " " not in texts[r.doc_id]}
    assert 0.2 < sum(shares.values()) < 1


def plain_class_scores(rows, rule):
    """The class model by loops over words, for texts of one batch."""
    import xxhash

    texts = [(i, t.encode().lower().split() + [class_lm.END]) for i, t in rows]
    lines = [t for i, t in texts if not class_lm.is_held_out(i)]
    counts = Counter(w for t in lines for w in t)
    key = {w: np.array([xxhash.xxh3_64_intdigest(w)], dtype="u8").view("i8")[0] for w in counts}
    total = sum(counts.values())
    often = [w for w in counts if counts[w] >= max(1, int(total * rule.frequent_share))]
    top = sorted(often, key=lambda w: (-counts[w], key[w]))[: rule.frequent]
    unit = lambda w: top.index(w) if w in top else len(top) + class_lm.ending_of(w)
    chain = [class_lm.END, *(w for t in lines for w in t)]
    steps = list(zip(chain, chain[1:], strict=False))
    pairs = np.zeros((len(top) + class_lm.ENDINGS,) * 2)
    for a, b in steps:
        pairs[unit(a), unit(b)] += 1
    own = class_lm.exchange_classes(pairs, rule)
    k = own.max() + 1
    wide = [w for w in counts if w not in top and counts[w] >= rule.least_count]
    classes = {}
    of = lambda w: classes.get(w, own[unit(w)])

    def class_pairs():
        table = np.zeros((k, k))
        for a, b in steps:
            table[of(a), of(b)] += 1
        return table

    def chances(table):
        shares = (table.sum(axis=0) + rule.prior / k) / (table.sum() + rule.prior)
        return (table + rule.prior * shares) / (table.sum(axis=1) + rule.prior)[:, None]

    table, best = class_pairs(), -math.inf
    for _ in range(rule.wide_rounds):
        chance, kept = chances(table), dict(classes)
        chosen = {}
        for w in wide:
            before = [of(a) for a, b in steps if b == w != a]
            after = [of(b) for a, b in steps if a == w != b]
            times = max(len(before), len(after))
            worth = [
                sum(math.log(chance[a, c]) for a in before)
                + sum(math.log(chance[c, b]) for b in after)
                - times * math.log(table[:, c].sum() + rule.prior)
                for c in range(k)
            ]
            chosen[w] = int(np.argmax(np.round(worth, 9)))
        classes = chosen
        new = class_pairs()
        if class_lm.likelihood(new) <= best:
            classes = kept
            break
        table, best = new, class_lm.likelihood(new)
    size, kinds = np.zeros(k), np.zeros(k)
    for w, n in counts.items():
        size[of(w)] += n
        kinds[of(w)] += 1
    chance, out = chances(table), {}
    for i, text in texts:
        at, out[i] = of(class_lm.END), 0.0
        for w in text:
            c = of(w)
            emit = (counts[w] + rule.add) / (size[c] + rule.add * (kinds[c] + 1))
            out[i] += math.log10(chance[at, c] * emit)
            at = c
    return out, wide, classes


def test_class_scores_equal_a_plain_model(spark, monkeypatch):
    draw = random.Random(8)
    nouns, verbs = [f"n{i}o" for i in range(30)], [f"v{i}a" for i in range(30)]
    rows = [
        (i, " ".join(draw.choice(nouns if j % 2 else verbs) + draw.choice(["", "", ".", "s"]) for j in range(draw.randrange(40))))
        for i in range(60)
    ]
    rule = class_lm.ClassModel(frequent=6, classes=5, rounds=3, least_count=4, wide_rounds=3)
    want, wide, classes = plain_class_scores(rows, rule)
    assert len(wide) > 20 and len(set(classes.values())) > 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(class_lm, "BUCKET_BYTES", 500)
    got = {r.doc_id: r.score for r in class_lm.score_texts(docs, rule).collect()}
    assert got.keys() == want.keys()
    # Texts come in another order than in the plain run; only the end token stands between them.
    assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_best_classes_by_neighbours():
    table = np.array([[5.0, 900.0], [900.0, 5.0]])
    around = np.array([[0, 9, 0, 9], [9, 0, 9, 0], [0, 0, 0, 0]], dtype="f4")
    assert class_lm.best_classes(around, table).tolist() == [0, 1, 0]


def test_exchange_finds_planted_classes():
    draw = np.random.default_rng(4)
    truth = np.arange(40) % 4
    step = np.array([[0.05, 0.85, 0.05, 0.05], [0.05, 0.05, 0.85, 0.05], [0.05, 0.05, 0.05, 0.85], [0.85, 0.05, 0.05, 0.05]])
    pairs = np.zeros((40, 40))
    word = 0
    for _ in range(40_000):
        cls = draw.choice(4, p=step[truth[word]])
        new = int(draw.choice(np.flatnonzero(truth == cls)))
        pairs[word, new] += 1
        word = new
    own = class_lm.exchange_classes(pairs, class_lm.ClassModel(classes=4, rounds=20))
    assert len({(a, b) for a, b in zip(truth, own, strict=True)}) == 4


def repeat_truth(texts, length):
    seen, out = set(), []
    for data in texts:
        gone = np.zeros(len(data), dtype=bool)
        for p in range(len(data) - length + 1):
            part = data[p : p + length]
            if part in seen:
                gone[p : p + length] = True
            seen.add(part)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("batch_bytes", [1 << 20, 3_000])
def test_repeats(spark, monkeypatch, batch_bytes):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", batch_bytes)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 4_000)
    monkeypatch.setattr(suffix_dedup, "SLICE", 5_000)
    draw = random.Random(3)
    shared = [prose(draw, 30, 3000) for _ in range(4)]
    texts = [None, "", "x" * 99, "x" * 100, "x" * 101, "y" * 3000, "ab" * 500, shared[0][:100], shared[0][:99], "é" * 120]
    for _ in range(60):
        words = prose(draw, draw.randint(5, 200), 3000)
        cut = draw.randrange(len(words))
        texts.append(words[:cut] + draw.choice([*shared, "", shared[1][20:130], shared[2][5:]]) + words[cut:])
    texts += texts[12:20] + [prose(draw, 9_000, 3000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, bucket string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeat_digests(docs).collect()}
    want = repeat_truth([(t or "").encode() for t in texts], 100)
    assert [got[i] for i in range(len(texts))] == want


def test_repeats_of_awkward_rows(awkward, awkward_texts, nothing):
    rows = suffix_dedup.remove_repeats(awkward).collect()
    assert len(rows) == len(rows_of(awkward_texts))
    for r in rows:
        assert r.n_bytes == len(r.kept) + sum(s.end - s.start for s in r.spans)
    assert suffix_dedup.repeat_digests(nothing).count() == 0


def test_levels_of_the_family_grow_geometrically():
    family, draw = suffix_dedup.SuffixFamily(), np.random.default_rng(1)
    prefixes = draw.integers(0, 5000, (40, 100)).astype("u8")
    for i, x in enumerate(prefixes):
        family.add(x, np.arange(100) + 100 * i)
    assert len(family.levels) <= 8
    flat = prefixes.ravel()
    first = {}
    for place, x in enumerate(flat.tolist()):
        first.setdefault(x, place)
    assert family.first_places(flat).tolist() == [first[x] for x in flat.tolist()]
    assert family.first_places(np.array([9999], dtype="u8"))[0] == np.iinfo("int64").max


def test_batches_are_scanned_against_the_levels_before_they_join():
    family = suffix_dedup.SuffixFamily()
    none, moved = family.add(np.array([5, 7, 5], "u8"), np.array([10, 11, 12]))
    assert none.tolist() == [False, False, True] and not len(moved)
    # 5 is there earlier; 7 is there later and gives way; 9 is new.
    found, moved = family.add(np.array([9, 7, 5], "u8"), np.array([1, 2, 30]))
    assert found.tolist() == [False, False, True] and moved.tolist() == [11]
    assert family.first_places(np.array([5, 7, 9], "u8")).tolist() == [10, 2, 1]


@pytest.mark.parametrize("chunk", [1, 50, 10_000])
@pytest.mark.parametrize("bits", [64, 6])
def test_matches_are_exact_when_digests_collide(chunk, bits):
    """With digests of six bits nearly all strings collide; the result is that of the strings."""
    draw, length = random.Random(9), 12
    runs, flat = [], []
    places = draw.sample(range(1000), 60)
    for i in range(60):
        text = "".join(draw.choice("ab") for _ in range(draw.choice([0, 3, 9]))) + draw.choice(["x" * 14, "hello world, hello", "abcdabcdabcdabcd"])
        data = text.encode()
        count = len(data) - length + 1
        runs.append((data, np.array([count], "u2"), np.array([places[i] * 100])))
        flat += [(places[i] * 100 + k, i, k, data[k : k + length]) for k in range(count)]
    weak = lambda *x: suffix_dedup.span_digests(*x) >> np.uint64(64 - bits)
    got = suffix_dedup.BucketMatches(length, weak).of(runs, chunk)
    seen = set()
    for _, i, k, part in sorted(flat):
        assert got[i][k] == (part in seen)
        seen.add(part)


def page(body, title="t"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a='</p><p>x';</script></head><body>{body}</body></html>"


LONG = "Some real words of the story stand here, and there are many of them in every paragraph of it."
PAGES = {
    "plain": (page(f"<nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title</h1><p>{LONG}<br>second &amp; line</p><p>a  b\n c</article><footer>&copy; x</footer>"), f"Title\n{LONG}\nsecond & line\na b c"),
    "unclosed": (page(f"<div class=ad>Buy</div><article><h1>T</h1><p><b>{LONG}<p>next<ul><li>one<li>two</ul></article><div id='comments'><p>{LONG * 9}</p></div>"), f"T\n{LONG}\nnext\none\ntwo"),
    "sidebar": (page(f"<div class='layout has-sidebar'><div class='sidebar-2'><p>{LONG * 3}</p></div><div class='post post-17'><p>{LONG}</p><form><p>Name</p></form><div class='share'>Share</div><p>End.</p></div></div>"), f"{LONG}\nEnd."),
    "table": (page(f"<main><table><tr><td>{LONG}<td>b<tr><td>c</table><!-- x <p>no</p> --><p>&lt;p&gt; &#x41;&nbsp;z</p></main>"), f"{LONG}\nb\nc\n<p> A z"),
    "hidden": (page(f"<article><p>{LONG}</p><p style='display:none'>no</p><p hidden>no</p><aside>no</aside><div class='cookie-notice'>no</div></article>"), LONG),
    "text only": (LONG, LONG),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    html, want = PAGES[name]
    cast = extraction.vote(html)
    assert extraction.text_on(html, cast[0]) == want
    assert extraction.text_on(html, None) == want


def test_host_vote_overrules_a_page(spark):
    usual = page(f"<div class='post p-1'><p>{LONG}</p></div><div class='box'><p>short</p></div>")
    odd = page(f"<div class='post p-2'><p>{LONG}</p></div><div class='box'><p>{LONG * 2}</p></div>")
    rows = [(i, "https://A.example:80/x", usual, 1, 2) for i in range(5)] + [(9, "http://user@a.example/y", odd, 1, 2)]
    rows += [(10, None, None, 1, 2), (11, "http://b.example", "", 1, 2), (12, "nonsense", "<p>", None, None), (9, "http://a.example/y", odd, 1, 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, main_text int, path int")
    got = extraction.main_texts(pages)
    assert got.columns == ["page_id", "url", "path", "main_text"]
    texts = [(r.page_id, r.main_text) for r in got.collect()]
    assert Counter(texts) == Counter([(i, LONG) for i in range(5)] + [(9, LONG)] * 2 + [(10, ""), (11, ""), (12, "")])
    assert extraction.page_texts(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith("op") or n == "pipeline"))
def test_registered_queries(spark, name):
    difference, _ = compare(spark, SF, entry.queries()[name], entry.oracle_sql().get(name))
    assert not difference or (difference == "no rows" and name == "op2_contamination")


def test_all_operators_and_the_pipeline_are_registered():
    names = [n for n in entry.queries() if n.startswith("op") and n[2:].split("_")[0].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_class_model_keeps_no_superseded_batches(spark):
    """Batches without counts and the counts' own table go once both stand together."""
    from pathlib import Path

    from shelfvec.sources.scratch import scratch_root

    folder = Path(scratch_root(spark).removeprefix("file:")) / "shelfvec" / spark.sparkContext.applicationId
    before = set(folder.glob("*"))
    docs = spark.createDataFrame([(i, f"one two{i % 7} three") for i in range(300)], "doc_id long, text string")
    out = class_lm.score_texts(docs)
    stored = {p.name.rsplit("-", 1)[0] for p in set(folder.glob("*")) - before}
    assert "classed" in stored and not stored & {"batches", "word-counts", "counted"}
    assert out.count() == 300
