"""Words of a text as they are compared: folded, without case, marks and invisible characters."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

_WORD = re.compile(r"[^\W_]+")
#: Words whose hashes a worker remembers.
_REMEMBERED = 500_000
_hashes: dict[str, int] = {}


def folded(text: str) -> str:
    """Compatibility folding (NFKD), no case, no combining marks, no format characters such as soft hyphens."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    return "".join(c for c in text if unicodedata.category(c) not in ("Mn", "Mc", "Me", "Cf"))


def words(text: str | None) -> list[str]:
    """The longest runs of letters and digits of the folded text; none for NULL."""
    return _WORD.findall(folded(text)) if text else []


def word_hashes(found: list[str]) -> np.ndarray:
    """64-bit hashes, the same on every machine."""
    out = np.empty(len(found), np.uint64)
    for i, w in enumerate(found):
        h = _hashes.get(w)
        if h is None:
            if len(_hashes) >= _REMEMBERED:
                _hashes.clear()
            h = _hashes[w] = xxhash.xxh64_intdigest(w)
        out[i] = h
    return out
