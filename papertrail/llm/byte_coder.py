"""Token ids of a byte-level BPE file, as the tokenizers library gives them.

A file whose merges stand in the order of their ids, with the plain byte-level pre-tokens and without a normaliser, means
the same to the tiktoken library, which is several times faster: ranks are read from the file itself, and special strings
are met whole, as the tokenizers library does by default.  Any other file goes to the tokenizers library, and so does a text
that tiktoken refuses.  Tests compare the two on all code points.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

#: The pre-tokens of the byte-level scheme (a fixed value).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteCoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.quick = _ranked(path)

    def encode(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit integers."""
        if self.quick is not None:
            try:
                return self.quick.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # its pattern matcher runs out of stack on a very long run of blanks
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def _ranked(path: str):
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    vocab, merges = model["vocab"], model.get("merges", [])
    joined = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in merges]
    added = spec.get("added_tokens") or []
    plain = model.get("type") == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" \
        and not pre.get("add_prefix_space") and pre.get("use_regex", True) \
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                                           "byte_fallback", "ignore_merges")) \
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["special"] for t in added) \
        and None not in joined and joined == sorted(joined) and len(vocab) == len(merges) + 256 \
        and (not joined or joined[0] == 256)
    if not plain:
        return None
    import tiktoken
    byte = {c: b for b, c in _alphabet().items()}
    special = {t["content"]: t["id"] for t in added}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens=special)


def _alphabet() -> dict[int, str]:
    """Byte -> its character: printable ones stand for themselves, the others for the characters from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printed]
    return {**{b: chr(b) for b in printed}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


@lru_cache(maxsize=2)
def byte_coder(path: str) -> ByteCoder:
    return ByteCoder(path)
