"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of bytes of a class; classes never split a UTF-8 character, so words of bytes are words of characters.
Hashes are of 64 bits: a random number per byte times a power of an odd base, summed over the word, then mixed.  Two
different words of a corpus share a hash with a chance of about 2^-64 a pair.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from papertrail.llm.common import chunks

_BYTE = np.arange(256)
#: Everything but blank, tab, line feed, vertical tab, form feed, carriage return.
NOT_BLANK = ~((_BYTE == 0x20) | ((_BYTE >= 0x09) & (_BYTE <= 0x0D)))
#: Digits, ASCII letters, and every byte of a non-ASCII character.
ALNUM = ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | ((_BYTE >= 0x41) & (_BYTE <= 0x5A)) | (_BYTE >= 0x80)
LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 32, _BYTE).astype(np.uint8)

_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD1342543DE82EF95)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a hash: every bit depends on all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


@lru_cache(maxsize=2)
def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)


@dataclass
class Words:
    """Words of documents ``first`` to ``first + n_docs``; ``doc`` counts from 0; positions are into ``lower``."""

    first: int
    n_docs: int
    lower: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def text(self, i: int) -> str:
        return self.lower[self.start[i]:self.end[i]].tobytes().decode("utf-8", "replace")

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the k words from each word on, whether they lie in one document)."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, bool)
        h = self.hash[:n].copy()
        for j in range(1, k):
            h *= _STEP
            h += self.hash[j:j + n]
        return mix(h + np.uint64(k)), self.doc[:n] == self.doc[k - 1:k - 1 + n]


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
    """``Words`` of consecutive documents, a quarter of a megabyte at a time; ASCII letters are lower-cased."""
    for first, last in chunks(offsets):
        at = offsets[first:last + 1] - offsets[first]
        lower = LOWER[data[offsets[first]:offsets[last]]]
        inside = kind[lower]
        before = np.empty(len(inside) + 1, bool)
        before[0] = False
        before[1:] = inside
        before[at] = False
        start = np.flatnonzero(inside & ~before[:-1])
        after = np.empty(len(inside) + 1, bool)
        after[-1] = False
        after[:-1] = inside
        after[at] = False
        end = np.flatnonzero(inside & ~after[1:]) + 1
        size = 1 << max(18, int(len(lower)).bit_length())
        power, inverse = _tables(size)
        total = np.zeros(len(lower) + 1, np.uint64)
        np.cumsum(_VALUE[lower] * power[:len(lower)], out=total[1:])
        h = (total[end] - total[start]) * inverse[start]
        doc = (np.searchsorted(at, start, side="right") - 1).astype(np.int64)
        yield Words(first, last - first, lower, doc, start, end, mix(h + (end - start).astype(np.uint64)))


def hash_words(items: list[str]) -> np.ndarray:
    """Hashes of given words, equal to those of ``words``."""
    raw = [x.encode() for x in items]
    at = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    return np.concatenate([w.hash for w in words(np.frombuffer(b"".join(raw), np.uint8), at, np.ones(256, bool))]
                          or [np.empty(0, np.uint64)])
