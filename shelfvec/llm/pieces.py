"""SentencePiece encoding and decoding.

The encoder finds the merge-type segmentation without running merges over the
text. Aho-Corasick matching lists the pieces that start at each character, the
longest one is tried first, and it may follow the piece before it only if
merging the two pieces' characters from scratch gives these two pieces back.
Where no piece fits, the last one is given up and its end is marked in a
bitfield of failed positions, which no later attempt may end at. A text's
prefixes have one segmentation each, so a position fails for good.

No piece of such a vocabulary has a space sign after another character, so text
falls apart into words with their leading space signs; words repeat and their
ids are kept in a bounded memo.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfvec.llm.arrow_rows import list_column, texts_of
from shelfvec.sources.shipping import ensure_shipped

SPACE = "▁"
#: Words kept in a worker's memo, and the longest word worth keeping.
MEMO_WORDS, MEMO_CHARS = 400_000, 64

_loaded: dict[str, PieceCodec] = {}


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def codec(model_file: str) -> PieceCodec:
    """One codec for each worker process and model."""
    if model_file not in _loaded:
        _loaded[model_file] = PieceCodec(model_file)
    return _loaded[model_file]


class PieceCodec:
    """Ids of texts under a merge-type model file with byte fallback.

    The model must have a space sign put before the text, other white space
    left alone and no character rewriting, which is checked on loading.
    """

    def __init__(self, model_file: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=model_file)
        sp = self.library
        probe = " a  Äﬁ\n\t b "
        if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError(f"{model_file} rewrites characters or white space")
        size = sp.get_piece_size()
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.scores[piece], self.ids[piece] = sp.get_score(i), i
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError(f"{model_file} has pieces that span words")
        if len(self.bytes) != 256:
            raise ValueError(f"{model_file} has no byte fallback")
        self.byte_ids = frozenset(self.bytes.values())
        self.matcher = ahocorasick.Automaton()
        for piece in self.ids:
            if self.merged(piece) == [piece]:
                self.matcher.add_word(piece, piece)
        self.matcher.make_automaton()
        self.longest = max(map(len, self.matcher.keys()))
        #: The longest shorter piece that a piece starts with; of one character at least.
        self.shorter: dict[str, str | None] = {
            p: next((p[:n] for n in range(len(p) - 1, 0, -1) if n == 1 or self.matcher.exists(p[:n])), None)
            for p in self.matcher.keys()
        }
        self.newline_splits = not any("\n" in p for p in self.ids)
        self.fits: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, bytes] = {"": b""}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging: best score first, leftmost of equals."""
        parts = list(text)
        scores = self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: str, right: str) -> bool:
        key = (left, right)
        found = self.fits.get(key)
        if found is None:
            if len(self.fits) >= 4 * MEMO_WORDS:
                self.fits.clear()
            found = self.fits[key] = self.merged(left + right) == [left, right]
        return found

    def longest_at(self, word: str, at: int) -> str:
        rest = word[at : at + self.longest]
        size = self.matcher.longest_prefix(rest)
        while size > 1 and rest[:size] not in self.shorter:
            size -= 1
        return rest[: size or 1]

    def segmented(self, word: str) -> list[str]:
        """Pieces of a word; characters outside the vocabulary stand alone.

        The chain of longest matches holds for most words as it is. From its
        first pair that does not fit, the search goes on step by step.
        """
        found: list[str] = []
        fits, at = self.fits, 0
        for end, piece in self.matcher.iter_long(word):
            start = end + 1 - len(piece)
            while at < start:  # characters that start no piece
                if found and not self.may_follow(found[-1], word[at]):
                    break
                found.append(word[at])
                at += 1
            if at < start:
                break
            if found:
                key = (found[-1], piece)
                if not (fits[key] if key in fits else self.may_follow(*key)):
                    break
            found.append(piece)
            at = end + 1
        return found if at == len(word) else self.searched(word, found, at)

    def searched(self, word: str, found: list[str], at: int) -> list[str]:
        """Complete a segmentation whose pieces up to a position fit each other."""
        size, fits, shorter = len(word), self.fits, self.shorter
        failed = bytearray(size // 8 + 1)
        while at < size:
            piece = self.longest_at(word, at)
            last = found[-1] if found else None
            while piece is not None:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1:
                    if last is None:
                        break
                    key = (last, piece)
                    if fits[key] if key in fits else self.may_follow(last, piece):
                        break
                piece = shorter.get(piece)
            if piece is None:
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(found.pop())
            else:
                found.append(piece)
                at = end
        return found

    def word_ids(self, word: str) -> bytes:
        """Ids of a word as little-endian 32-bit integers."""
        out: list[int] = []
        for piece in self.segmented(word):
            i = self.ids.get(piece)
            if i is None:
                out.extend(self.bytes[b] for b in piece.encode())
            else:
                out.append(i)
        return np.array(out, dtype="<i4").tobytes()

    def _kept(self, key: str, word: str) -> bytes:
        ids = self.word_ids(word)
        if len(key) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[key] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """All ids of a text as little-endian 32-bit integers; a null text is empty."""
        if not text:
            return b""
        memo = self.memo
        if SPACE not in text and "  " not in text:
            split = self.newline_splits
            words = text.replace("\n", " \n").split(" ") if split else text.split(" ")
            if "" not in words:
                return b"".join(
                    [
                        memo.get(w)
                        or self._kept(w, w if split and w[0] == "\n" else SPACE + w)
                        for w in words
                    ]
                )
        whole = SPACE + text.replace(" ", SPACE)
        return b"".join(self._kept_signed(w) for w in re.findall(f"{SPACE}+[^{SPACE}]*", whole))

    def _kept_signed(self, word: str) -> bytes:
        # Under its own spelling, which starts with the space sign and so is no other key.
        return self.memo.get(word) or self._kept(word, word)

    def encode_all(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        return [np.frombuffer(self.encode(t), dtype="<i4") for t in texts]

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


def encode_pieces(
    docs: DataFrame,
    text_col: str = "text",
    model_file: str | None = None,
    tokens_col: str = "tokens",
    decoded_col: str | None = None,
) -> DataFrame:
    """Add the ids of every whole text and, if asked for, the text they decode to.

    Row-local, no shuffle. A null or empty text has no ids and decodes to the
    empty string. Other columns pass through untouched; new columns of the same
    name replace them. The model file must lie at the same path on all workers.
    """
    path = model_file or model_path()
    ensure_shipped(docs.sparkSession)
    new = [tokens_col, *([decoded_col] if decoded_col else [])]
    rest = [f for f in docs.schema.fields if f.name not in new]
    schema = T.StructType([*rest, T.StructField(tokens_col, T.ArrayType(T.IntegerType(), False), False)])
    if decoded_col:
        schema = schema.add(T.StructField(decoded_col, T.StringType(), False))
    kept = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = codec(path)
        for batch in batches:
            ids = pieces.encode_all(texts_of(batch, text_col))
            columns = [batch.column(n) for n in kept] + [list_column(ids, pa.int32())]
            if decoded_col:
                columns.append(pa.array([pieces.decode(i) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])

    return docs.mapInArrow(run, schema)


def piece_digests(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """Per document the number of ids and digests of the ids and the decoded text."""
    coded = encode_pieces(docs.select("doc_id", "text"), model_file=model_file, decoded_col="decoded")
    return coded.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("tokens").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
