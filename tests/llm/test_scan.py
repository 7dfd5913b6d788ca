"""Words and their hashes over bytes against regular expressions; the bit table."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from papertrail.llm import bloom, scan
from papertrail.llm.common import chunks, utf8

PATTERNS = {"blank": (scan.NOT_BLANK, re.compile(r"[^\x20\x09-\x0D]+")),
            "alnum": (scan.ALNUM, re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))}
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXT = st.text(st.sampled_from(list(" \n\x0b\x1c\x85.,-aBZ09éß中😀\x00")))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | TEXT, max_size=6), st.sampled_from(sorted(PATTERNS)))
def test_words(texts, kind):
    mask, pattern = PATTERNS[kind]
    want = [pattern.findall((t or "").translate(LOW)) for t in texts]
    got = [[] for _ in texts]
    for w in scan.words(*utf8(pa.array(texts, pa.string())), mask):
        assert (scan.hash_words([w.text(i) for i in range(len(w.hash))]) == w.hash).all()
        for i in range(len(w.hash)):
            got[w.first + w.doc[i]].append(w.text(i))
    assert got == want


def test_hashes_do_not_depend_on_place():
    col = pa.array(["a bb ccc", "x" * 5000 + " bb", "bb ccc a bb"])
    w = next(scan.words(*utf8(col), scan.NOT_BLANK))
    by = {}
    for i in range(len(w.hash)):
        by.setdefault(w.text(i), set()).add(int(w.hash[i]))
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)
    h, whole = w.grams(2)
    assert h[1] == h[5] and whole.tolist() == [True, True, False, True, False, True, True, True]


def test_chunks_cover_all():
    at = np.cumsum([0, 5, 0, 100, 1, 1, 1, 0])
    got = list(chunks(at, 10))
    assert got[0][0] == 0 and got[-1][1] == 7 and all(a[1] == b[0] for a, b in zip(got, got[1:]))


def test_sliced_columns():
    col = pa.array(["a", None, "b c", "d"]).slice(1, 2)
    w = next(scan.words(*utf8(col), scan.NOT_BLANK))
    assert [w.text(i) for i in range(len(w.hash))] == ["b", "c"] and w.counts().tolist() == [0, 2]


def test_bloom(spark):
    keys = np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64)
    keys[:10] |= np.uint64(1 << 63)
    table = bloom.build(spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "k long"), "k", 18)
    others = np.random.default_rng(1).integers(0, 1 << 63, 10000, dtype=np.uint64)
    assert bloom.test(table, keys).all() and bloom.test(table, others).mean() < 0.01
    assert not bloom.test(bloom.build(spark.createDataFrame([], "k long"), "k", 18), keys).any()
