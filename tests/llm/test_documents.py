"""Rules, lines, near copies, test items and the pipeline on awkward and small tables."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfvec.llm import contamination, fertility, lines, pieces, simhash
from shelfvec.operators.components import components
from tests.llm.conftest import prose, rows_of


def plain_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def test_quality_figures(awkward):
    got = fertility.quality_verdicts(awkward).join(awkward.select("doc_id", "text"), "doc_id").collect()
    codec = pieces.PieceCodec(pieces.model_path())
    for r in got:
        words = plain_words(r.text)
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in r.text or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        times = Counter(windows)
        again = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
        assert r.n_repeat_words == len(again)
        full = [x for x in (r.text or "").split("\n") if plain_words(x)]
        assert r.n_dup_lines == len(full) - len(set(full))
        assert r.base_failed == (len(words) < 50 or 100 * len(again) > 50 * len(words))
        assert not (r.base_failed and r.kept)
        assert r.n_tokens == len(codec.library.encode(r.text or ""))


def test_bands_reject_shouting_and_noise(spark):
    draw = random.Random(2)
    good = [prose(draw, 200, 3000) for _ in range(60)]
    noise = [t.upper().replace(" ", "!! ") for t in good[:3]] + ["é" + "鱻龘" * 300 + " w" * 80]
    noise += [t.replace(" ", "%$ ") for t in good[:3]]
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(good + noise)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in fertility.keep_good(docs).collect()}
    assert kept == set(range(60))
    assert fertility.script_of("Привет, мир") == "cyrillic" and fertility.script_of("12!") == "none"


def line_truth(rows, min_sites=10):
    sites = defaultdict(set)
    bare = lambda x: x.strip(" \t\r")
    for _, text, _, source, *_ in rows:
        for x in (text or "").split("\n"):
            if bare(x) and source is not None:
                sites[bare(x)].add(source)
    out = []
    for _, text, *_ in rows:
        cut = [x for x in (text or "").split("\n") if len(sites.get(bare(x), ())) >= min_sites]
        if text is None or not cut or sum(map(len, cut)) > 0.5 * len(text):
            out.append(text)
        else:
            out.append("\n".join(x for x in text.split("\n") if len(sites.get(bare(x), ())) < min_sites))
    return out


@pytest.mark.parametrize("lg_k", [4, 10])
def test_lines(awkward, awkward_texts, lg_k):
    got = lines.drop_spread_lines(awkward, lg_k=lg_k)
    assert got.columns == awkward.columns
    want = line_truth(rows_of(awkward_texts))
    assert Counter(r.text for r in got.collect()) == Counter(want)
    assert want != [r[1] for r in rows_of(awkward_texts)]


def test_short_pages_lose_boilerplate_but_not_their_own_lines(spark, tmp_path):
    boiler = ["All rights reserved on every site.", "Read our terms before you go on."]
    texts = ["\n".join([*boiler, f"own line {i}"]) for i in range(12)] + ["\n".join(boiler), f" \n{boiler[0]}\n"]
    rows = [(i, t, f"site{i}", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in dict(corpus_pipeline.STAGES)["lines"](spark, docs, str(tmp_path)).collect()}
    assert got == {i: (x, len(x)) for i, x in enumerate([f"own line {i}" for i in range(12)] + texts[12:])}


def test_lines_stay_native(awkward):
    plan = lines.line_digests(awkward)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_fingerprint_by_definition():
    import xxhash

    text = "The cat  sat\ton the mat. THE CAT sat on"
    words = text.lower().split()
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("Two words") == xxhash.xxh64_intdigest(b"two words", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_fingerprints_agree_with_the_native_hash(spark):
    row = spark.sql("SELECT xxhash64('a b c') AS h").first()
    assert simhash.fingerprint("a b c") == row.h % (1 << 64)


def test_gray_index_finds_all_close_pairs():
    draw = np.random.default_rng(3)
    values = draw.integers(0, 1 << 64, 300, dtype="u8")
    flips = np.uint64(1) << draw.integers(0, 64, (600, 3)).astype("u8")
    values = np.unique(np.concatenate([values, np.repeat(values, 2) ^ flips[:, 0], np.repeat(values, 2) ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2]]))
    index = simhash.GrayIndex(values)
    who, node = index.within(index.values, 2)
    apart = np.bitwise_count(index.values[:, None] ^ index.values[None, :])
    assert set(zip(who.tolist(), node.tolist())) == set(zip(*(x.tolist() for x in np.where(apart <= 2))))
    assert simhash.GrayIndex(values[:1]).within(values[:1], 0)[0].tolist() == [0]


def component_truth(values):
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if bin(a ^ b).count("1") <= 2 and label[i] < label[j]:
                    label[j], changed = label[i], True
    return label


@pytest.mark.parametrize("chunk", [4096, 7])
def test_close_links_with_large_groups_cut(spark, chunk):
    draw = random.Random(9)
    center = draw.getrandbits(64)
    values = sorted({center ^ (1 << draw.randrange(20)) ^ (1 << draw.randrange(20)) ^ (1 << draw.randrange(64)) for _ in range(60)} | {draw.getrandbits(64) for _ in range(60)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r.node: r.root for r in components(simhash.close_links(frame, 2, chunk)).collect()}
    groups = defaultdict(set)
    for v, k in zip(signed, component_truth(values), strict=True):
        groups[k].add(v)
    found = defaultdict(set)
    for v in signed:
        found[roots.get(v, v)].add(v)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in found.values()}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    roots = {r.node: r.root for r in components(edges).collect()}
    assert roots == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_fingerprint_components(awkward, awkward_texts):
    got = simhash.fingerprint_components(awkward).collect()
    rows = rows_of(awkward_texts)
    assert len(got) == len(rows)
    values = [simhash.fingerprint(r[1]) for r in rows]
    least = defaultdict(list)
    labels = component_truth(values)
    for label, r in zip(labels, rows, strict=True):
        least[label] += [r[0]] if r[0] is not None else []
    want = Counter((r[0], f"{v:016x}", min(least[k], default=None)) for r, v, k in zip(rows, values, labels, strict=True))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_one_of_copies(awkward, awkward_texts):
    kept = simhash.keep_one_of_copies(awkward)
    assert kept.columns == awkward.columns
    got = [r.doc_id for r in kept.collect()]
    rows = rows_of(awkward_texts)

    def grams(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {None}

    sets = [grams(r[1]) for r in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if label[i] < label[j] and len(a & b) >= 0.8 * len(a | b):
                    label[j], changed = label[i], True
    groups = defaultdict(list)
    for k, r in zip(label, rows, strict=True):
        groups[k].append((r[0] is None, r[0]))
    assert Counter(got) == Counter(min(g)[1] for g in groups.values())


def test_one_of_component(awkward, awkward_texts):
    """The pipeline's stage: the smallest id of each component of close fingerprints."""
    kept = simhash.keep_one_of_component(awkward)
    assert kept.columns == awkward.columns
    rows = rows_of(awkward_texts)
    groups = defaultdict(list)
    for label, r in zip(component_truth([simhash.fingerprint(r[1]) for r in rows]), rows, strict=True):
        groups[label].append((r[0] is None, r[0]))
    assert Counter(r.doc_id for r in kept.collect()) == Counter(min(g)[1] for g in groups.values())


def least_of_copies(texts):
    """Of each component over five-word shingle sets at 0.8 the smallest number, by brute force."""
    split = [t.lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in split]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i + 1, len(sets)):
                if label[i] != label[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return sorted(set(label))


@pytest.mark.parametrize("options", [{}, {"chunk": 23, "common": 20}, {"small_group": 1_000, "common": 20}])
def test_star_of_copies_stays_one(spark, options):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(300)]

    def edited():
        out = list(base)
        for at in draw.sample(range(300), 5):
            out[at] = word()
        return " ".join(out)

    passage = " ".join(word() for _ in range(40))
    texts = [edited() for _ in range(100)] + [" ".join(base)] + [edited() for _ in range(100)]
    texts += [passage + " " + " ".join(word() for _ in range(80)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = sorted(r.doc_id for r in simhash.keep_one_of_copies(docs, **options).collect())
    assert kept == least_of_copies(texts)
    assert len(kept) < 60


def test_copies_with_a_line_repeated_are_found(spark):
    draw = random.Random(4)
    say = lambda n: " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    texts = []
    for _ in range(24):
        page, line = say(300), say(8)
        texts += [f"{page}\n{line}", page + f"\n{line}" * 20]
    apart = [(simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).bit_count() for a, b in zip(texts[::2], texts[1::2], strict=True)]
    assert max(apart) > 24
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = sorted(r.doc_id for r in simhash.keep_one_of_copies(docs).collect())
    assert kept == least_of_copies(texts) == list(range(0, 48, 2))


@pytest.mark.parametrize("alphabet", [40, 4_000])
def test_set_pairs_by_brute_force(alphabet):
    draw = random.Random(3)
    base = [draw.randrange(alphabet) for _ in range(30)]
    sets = [np.unique([v if draw.random() < 0.95 else draw.randrange(alphabet) for v in base]).astype("u8") for _ in range(90)]
    got = simhash.set_pairs(sets, 0.8)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            x, y = set(a.tolist()), set(b.tolist())
            assert got[i, j] == (i < j and len(x & y) >= 0.8 * len(x | y))


ITEMS = [
    (1, "Which of the rivers that cross the old town is the longest? The river Lena, by far, in all of its seasons."),
    (2, "Two plus two is four and four plus four is eight as every child in this school will know by heart."),
    (3, "Short item here"),
    (4, None),
    (5, ""),
    (6, "!!!"),
    (None, "An item without a number is found by its text like any other item of the set would be."),
]


def test_leaks(spark, nothing):
    draw = random.Random(4)
    filler = [prose(draw, n) for n in (10, 300, 900, 2000, 40, 5000)]
    one, two = ITEMS[0][1], ITEMS[1][1]
    half = " ".join(two.split()[:8])
    swapped = two.replace("child", "pupil")
    texts = [
        filler[1] + " " + one + " " + filler[2],
        one.upper().replace(" ", "\n"),
        filler[3] + " " + two + " " + one + " " + filler[0],
        filler[2] + " " + half + " " + filler[1],
        filler[0] + " " + swapped,
        "a Short, item here!",
        "short here item",
        filler[5] + ITEMS[6][1],
        filler[4], None, "", one,
    ]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, leaks int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contamination.leaks_of(docs, items).collect()}
    assert got == {(0, 1), (1, 1), (2, 1), (2, 2), (5, 3), (7, None), (11, 1)}
    clean = contamination.without_leaks(docs, items)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id, r.leaks) for r in clean.collect()) == [(i, i) for i in (3, 4, 6, 8, 9, 10)]
    assert contamination.leaks_of(docs, items.limit(0)).count() == 0
    assert contamination.leaks_of(nothing, items).count() == 0


def test_wand_gives_all_items_that_full_scoring_gives():
    draw = random.Random(8)
    items = [(i, prose(draw, draw.randint(5, 60), 150)) for i in range(300)]
    index = contamination.ItemIndex(items, contamination.Search(min_score=0.3, block=4))
    found = 0
    for _ in range(60):
        terms = np.unique(index.term_ids(prose(draw, 100, 150).split())).tolist()
        terms = [t for t in terms if t < len(index.terms)]
        scores = defaultdict(float)
        for t in terms:
            for item, weight in zip(*index.postings[t][:2], strict=True):
                scores[item] += weight
        want = {i: s for i, s in scores.items() if s >= 0.3 - 1e-9}
        got = dict(index.search(terms))
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in got)
        found += len(got)
    assert found


def test_leaks_against_brute_force(spark):
    draw = random.Random(6)
    items = [(i, prose(draw, draw.randint(15, 60), 2000)) for i in range(40)]
    texts = []
    for k in range(120):
        words = prose(draw, draw.randint(50, 700), 2000).split()
        if k % 3 == 0:
            leak = items[k % 40][1].split()
            for _ in range(k % 4):
                leak[draw.randrange(len(leak))] = "altered"
            at = draw.randrange(len(words))
            words[at:at] = leak
        texts.append(" ".join(words))
    rule = contamination.Search()
    parts = {i: contamination.question_and_answer(t, 5) for i, t in items}
    want = set()
    for d, t in enumerate(texts):
        seen = set(contamination.shingles(contamination.plain_words(t), 5))
        for i, (q, a) in parts.items():
            n, m = sum(s in seen for s in q), sum(s in seen for s in a)
            if n + m >= 0.8 * (len(q) + len(a)) and n >= 0.5 * len(q) and m >= 0.5 * len(a):
                want.add((d, i))
    index = contamination.ItemIndex(items, rule)
    got = {(d, leak[0]) for d, t in enumerate(texts) for leak in index.leaks(t)}
    assert got == want and len(want) > 15


def test_pipeline_stages(spark, awkward, nothing, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for start in (awkward, nothing):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            before = docs.columns
            docs = stage(spark, docs, folder)
            assert docs.columns == (before if name != "tokens" else [*(c for c in before if c != "tokens"), "tokens"])
        assert docs.count() >= 0


def test_tokens_are_decoded_and_compared(spark, monkeypatch):
    texts = ["plain words", " two  spaces ", "a▁b\n\tc", "日本語", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["tokens"]
    library = pieces.PieceCodec(pieces.model_path()).library
    got = {r.doc_id: (r.text, r.tokens) for r in stage(spark, docs, "").collect()}
    assert got == {i: (t, library.encode(t or "")) for i, t in enumerate(texts)}
    plain = pieces.encode_pieces

    def wrong(docs, **names):
        out = plain(docs, **names)
        return out.withColumn(names["decoded_col"], F.lit("other")) if "decoded_col" in names else out

    monkeypatch.setattr(pieces, "encode_pieces", wrong)
    with pytest.raises(Exception, match="do not decode"):
        stage(spark, docs, "").collect()


def test_pipeline_against_plain_steps(spark):
    """Every stage on the smallest table against the plainest way to do it."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: (r.text, r.tokens) for r in corpus_pipeline.run(spark, folder).collect()}
    verdicts = fertility.quality_verdicts(docs).where("kept").select("doc_id")
    rows = [tuple(r) for r in docs.join(verdicts, "doc_id").select("doc_id", "text", "lang", "source").orderBy("doc_id").collect()]
    texts = dict(zip([r[0] for r in rows], line_truth(rows), strict=True))

    labels = component_truth([simhash.fingerprint(t) for t in texts.values()])
    kept = sorted({label: i for label, i in reversed(list(zip(labels, texts, strict=True)))}.values())
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    parts = [contamination.question_and_answer(t, 5) for t in items]
    library = pieces.PieceCodec(pieces.model_path()).library
    want = {}
    for i in kept:
        seen = set(contamination.shingles(contamination.plain_words(texts[i]), 5))
        counts = [(sum(s in seen for s in q), len(q), sum(s in seen for s in a), len(a)) for q, a in parts]
        if not any(n + m >= 0.8 * (x + y) and n >= x / 2 and m >= y / 2 for n, x, m, y in counts):
            want[i] = (texts[i], library.encode(texts[i]))
    assert got == want


@pytest.mark.parametrize("make", [fertility.quality_verdicts, lines.line_digests, simhash.fingerprint_components, simhash.keep_one_of_copies, simhash.keep_one_of_component, fertility.keep_good])
def test_empty_tables(nothing, make):
    assert make(nothing).count() == 0


def test_long_texts_are_read_whole(spark):
    long = prose(random.Random(1), 60_000)
    docs = spark.createDataFrame([(0, long + "\n" + ITEMS[0][1], "en", "s")], "doc_id long, text string, lang string, source string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contamination.leaks_of(docs, items).count() == 1
    assert fertility.quality_verdicts(docs).first().n_words == len((long + " " + ITEMS[0][1]).split())
    assert lines.line_digests(docs).where(F.col("n_removed_lines") > 0).count() == 0
