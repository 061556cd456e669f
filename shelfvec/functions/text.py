"""Text expressions. All run inside the JVM; none needs a Python worker.

Java, Python and RE2 disagree on the shorthand classes once a text leaves
ASCII, so the classes are spelled out.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes equal to Unicode-aware \s and \w.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
WORD = r"\p{L}\p{N}_"

# Patterns and replacement of the catalog cleaning rules.
TAG_PATTERN = r"<[^>]+>"
PUNCTUATION_PATTERN = f"[^{WORD}{SPACE}]"
SPACES_PATTERN = f"[{SPACE}]+"
NO_WORD_PATTERN = f"[^{WORD}]+"
BLANK_PATTERN = f"^[{SPACE}]*$"
NO_INFO = "No info"

CYRILLIC_PATTERN = r"[\p{IsCyrillic}&&\p{L}]"
ALPHABETIC_PATTERN = r"^\p{L}+$"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def fill_blank(value: Column | str, filler: str = NO_INFO) -> Column:
    """Replace an empty or whitespace-only string; null stays null."""
    value = as_column(value)
    return F.when(value.rlike(BLANK_PATTERN), F.lit(filler)).otherwise(value)


def words(value: Column | str) -> Column:
    """Whitespace tokens of an already cleaned text; a blank text has none."""
    return F.filter(F.split(as_column(value), " "), lambda token: token != F.lit(""))


def lower_tokens(value: Column | str) -> Column:
    """Lower-case tokens between any white space; null for a null text."""
    parts = F.split(F.lower(as_column(value)), f"[{SPACE}]+")
    return F.filter(parts, lambda token: token != F.lit(""))


def clean_text(value: Column | str, drop_words: Sequence[str] = ()) -> Column:
    """Strip tags and punctuation, drop ``drop_words``, collapse whitespace.

    Case is kept. ``drop_words`` are literal text matched on word boundaries,
    in the given order.
    """
    text = F.regexp_replace(as_column(value), TAG_PATTERN, " ")
    if all(map(_is_word, drop_words)):
        # Whatever is no word character ends up as one space: a single pass.
        text = F.trim(F.regexp_replace(text, NO_WORD_PATTERN, " "))
        if not drop_words:
            return text
        # Tokens are whole words, so a hashed set test drops any number of them.
        kept = F.filter(F.split(text, " "), lambda token: ~token.isin(*drop_words))
        return F.array_join(kept, " ")
    # Phrases are matched before whitespace is collapsed.
    text = F.regexp_replace(text, PUNCTUATION_PATTERN, " ")
    for word in drop_words:
        text = F.regexp_replace(text, _whole(word), " ")
    return F.trim(F.regexp_replace(text, SPACES_PATTERN, " "))


def _is_word(text: str) -> bool:
    return text != "" and all(ch.isalnum() or ch == "_" for ch in text)


def _whole(phrase: str) -> str:
    quoted = "\\Q" + phrase.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return f"(?<![{WORD}]){quoted}(?![{WORD}])"


def null_as_word(value: Column | str, word: str = "nan") -> Column:
    """A null text is read as the word ``nan`` by the normalisation rules."""
    return F.coalesce(as_column(value), F.lit(word))


def has_cyrillic(value: Column | str) -> Column:
    return as_column(value).rlike(CYRILLIC_PATTERN)


def shares_word(tokens: Column | str, keywords: Iterable[str]) -> Column:
    """True when the token list holds at least one of ``keywords``."""
    distinct = sorted(set(keywords))
    return F.arrays_overlap(
        as_column(tokens), F.array(*[F.lit(word) for word in distinct])
    )


def evaluated_once(value: Column) -> Column:
    """``value``, kept from being copied into filters that refer to it.

    A filter on a computed column is normally pushed below the projection,
    which computes the column once for the filter and again for the result.
    That is a loss when the column costs a pass over a long text.
    """
    return F.when(F.spark_partition_id() >= 0, value)
