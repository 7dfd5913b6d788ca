"""Token ids of the word-level BPE file, as its library gives them, with a bounded cache in front.

The file's pattern drops white space and no token spans it, so a text's ids are those of its blank-separated words in
order.  Two kinds of words are taken apart further, at places that no token spans either: a word of plain ASCII without
apostrophes or angle brackets, into runs of letters, digits, and runs of other characters; and a word of letters of any
script with ASCII signs behind it.  A run of letters goes to the library's BPE model directly, in the form the file's
normaliser would give it.  Any other word goes to the library whole.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
from functools import lru_cache

import numpy as np

_PARTS = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
_WHOLE = re.compile(rb"['<\x00-\x1f\x7f]")
_SIGNS = ".,;:!?%#*&$|)"
_ASCII_SIGNS = _SIGNS.encode()
#: The byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_REST = [b for b in range(256) if b not in _PRINTED]
_ALPHABET = {b: 256 + i for i, b in enumerate(_REST)}


class WordCoder(dict):
    """word (bytes) -> its ids as little-endian unsigned 16- or 32-bit integers (bytes).

    Holds two generations of at most ``limit`` words: when the newer one is full it replaces the older, and words met
    again move over, so frequent words stay.
    """

    def __init__(self, path: str, limit: int = 400_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.limit, self.older = Tokenizer.from_file(path), limit, {}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.kind.itemsize == 2 else 'I'}", *ids)

    def _letters(self, word: str) -> bytes:
        """Ids of lower-case letters in composed form."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_ALPHABET)
        return self._packed([t.id for t in self.model.tokenize(word)])

    def _ids(self, word: bytes) -> bytes:
        plain = word.rstrip(_ASCII_SIGNS)
        if plain.isalpha():  # ASCII letters, and signs behind them
            low = plain.lower()
            if low == word:
                return self._letters(low.decode())
            return self[low] + self[word[len(plain):]] if len(plain) < len(word) else self[low]
        if word.isascii():
            if not _WHOLE.search(word):
                parts = _PARTS.findall(word.lower())
                if parts != [word]:
                    return b"".join([self[p] for p in parts])
        else:
            text = word.decode()
            head = text.rstrip(_SIGNS)
            # Sigma, whose lower case depends on its place, and capitals that become two characters stay with the library.
            if head.isalpha() and "Σ" not in head and "İ" not in head and unicodedata.is_normalized("NFC", head):
                low = head.lower()
                if low != text:
                    return self[low.encode()] + (self[text[len(head):].encode()] if len(head) < len(text) else b"")
                return self._letters(low)
        return self._packed(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._ids(word)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def encode(self, text: bytes, end: bytes = b"") -> bytes:
        """Ids of a whole UTF-8 text, then ``end``."""
        return b"".join(map(self.__getitem__, text.split())) + end


@lru_cache(maxsize=2)
def word_coder(path: str, limit: int = 400_000) -> WordCoder:
    return WordCoder(path, limit)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; any path may be given to the operators instead."""
    import public_tokenizers
    return public_tokenizers.path(name)
