"""Words of whole Arrow batches as stable 64-bit hashes, and hashes of word windows.

A word is a maximal run of letters or digits of the lower-cased text. Null and empty texts have no words.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
CACHE_WORDS = 1_000_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, elementwise."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts in order, number of words of each text)."""
    parts, counts = [], []
    for t in texts:
        w = WORD.findall(t.lower()) if t else []
        counts.append(len(w))
        if w:
            parts.append(np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w)))
    n = np.array(counts, np.int64)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), n


def windows(h: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index, position of its first word in h) of every run of `width` words inside one text."""
    doc = np.repeat(np.arange(len(n)), n)
    m = len(h) - width + 1
    if m <= 0:
        e = np.empty(0, np.int64)
        return np.empty(0, np.uint64), e, e
    at = np.flatnonzero(doc[:m] == doc[width - 1 :])
    out = mix(h[at])
    for i in range(1, width):
        out = mix(out * np.uint64(3) + h[at + i])
    return out, doc[at], at


def distinct_in(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) without repeats, sorted by text and hash."""
    o = np.lexsort((h, doc))
    h, doc = h[o], doc[o]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], doc[keep]
