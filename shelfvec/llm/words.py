"""Words of texts by fixed byte classes, the same in every operator."""

from __future__ import annotations

import re

#: A word is a run of anything but the space and the controls from tab to carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: White space to Python's own split but part of a word here.
_INSIDE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
#: A-Z to lower case, nothing else.
LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    return WORD.findall(text) if _INSIDE.search(text) else text.split()


def ascii_lower(text: str) -> str:
    return text.lower() if text.isascii() else text.encode().lower().decode()
