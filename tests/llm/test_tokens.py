from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from shelfvec.llm import pieces, token_files

ODD = [
    None, "", " ", "  ", "\n", " \n", "a \nb", "a  b", "▁", "▁a", "<s>", "</s>a", "<unk>", "<0x0A>",
    "\r\n\t", "   x   ", "🙂🙂", "trail ", "The, CAT. the... cat's it's", "<|endoftext|>, <|ENDOFTEXT|>",
    "T̈ẗ İ ΣΑΣ ß", "a\x1cb\x85c\xa0d e", "x" * 5000, "né. NÉ. É́,", "'s. ''s, 12,3. 4.",
]


def odd_texts():
    draw = random.Random(7)
    alphabet = list("abcthe  \n\t▁éßñÉ漢字🙂\x00 aaa...,,111<0x0A>'s|ـعرب́̈TB")
    return ODD + ["".join(draw.choices(alphabet, k=draw.randint(1, 60))) for _ in range(1500)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", i) for i, t in enumerate(odd_texts())] + [(3, "the", "x", 1), (None, "a", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, tokens int").repartition(5)


def test_pieces_equal_the_library(docs):
    codec = pieces.PieceCodec(pieces.model_path())
    rows = pieces.encode_pieces(docs, decoded_col="decoded").collect()
    assert len(rows) == len(odd_texts()) + 2
    assert rows[0].asDict().keys() == {"doc_id", "text", "lang", "tokens", "decoded"}
    for row in rows:
        want = codec.library.encode(row.text or "")
        assert row.tokens == want
        assert row.decoded == codec.library.decode(want)


def test_search_goes_back_where_longest_matches_fail():
    codec = pieces.PieceCodec(pieces.model_path())
    backed = 0
    for word in ("▁onenerth", "▁therrepa", "▁stionation", "▁eauouauxerent"):
        greedy = [piece for _, piece in codec.matcher.iter_long(word)]
        backed += greedy != codec.merged(word)
        assert codec.segmented(word) == codec.searched(word, [], 0) == codec.merged(word)
    assert backed


def test_token_files(spark, docs, tmp_path):
    encoder = token_files.WordEncoder(token_files.tokenizer_path())
    path = str(tmp_path / "tokens")
    token_files.write_token_files(docs, path, page_rows=100)
    got = token_files.read_tokens(spark, path).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    texts = dict(enumerate(odd_texts()))
    start = 0
    for row in got:
        assert row.start == start and row.n_tokens == len(row.tokens)
        start += row.n_tokens
        if row.doc_id not in (3, None):
            assert row.tokens == encoder.ids(texts[row.doc_id] or "") + [2], texts[row.doc_id]
    some = token_files.read_tokens(spark, path, 10, 20)
    assert {r.doc_id: r.start for r in some.collect()} == {r.doc_id: r.start for r in got if 10 <= (r.doc_id or 0) <= 20}
    file = next(f for f in tmp_path.glob("tokens/*.parquet") if pq.ParquetFile(f).metadata.num_rows)
    group = pq.ParquetFile(file).metadata.row_group(0)
    by_name = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert all(c.has_column_index and c.has_offset_index for c in by_name.values())
    assert "DELTA_BINARY_PACKED" in by_name["doc_id"].encodings
    assert any("DICTIONARY" in e for e in by_name["tokens.list.element"].encodings)


def test_digests(docs):
    encoder = token_files.WordEncoder(token_files.tokenizer_path())
    texts = dict(enumerate(odd_texts()))
    for row in token_files.token_digests(docs).collect():
        if row.doc_id not in (3, None):
            want = np.array(encoder.ids(texts[row.doc_id] or "") + [2], dtype="<u4")
            assert (row.n_tokens, row.ids_crc32) == (len(want), zlib.crc32(want.tobytes()))


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pieces.piece_digests(none).count() == 0
    assert token_files.token_digests(none).count() == 0
