"""Packing: every id in exactly one piece, no gaps, little padding; neighbours over plain BM25."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from papertrail.llm import packing
from papertrail.llm.coder import tokenizer_path, word_coder

WORDS = tokenizer_path("word_bpe_49k.json")


def ids_of(text):
    coder = word_coder(WORDS)
    return np.frombuffer(coder.encode((text or "").encode()), coder.kind).tolist() + [2]


def hold(pieces, rows, window):
    """pieces: rows of the query; rows: (doc_id, text)."""
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(ids_of(t))
    got = defaultdict(list)
    for p in pieces:
        got[p.doc_id].append(p)
    assert set(got) == set(want)
    for i, ps in got.items():
        assert sum(p.length for p in ps) == sum(map(len, want[i]))
        if len(want[i]) > 1:
            continue
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            cut = want[i][0][at:at + p.length]
            assert p.start == at and p.doc_tokens == len(want[i][0])
            assert p.ids_crc32 == zlib.crc32(np.array(cut, "<u4").tobytes())
            at += p.length
    windows = defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append((p.offset, p.length))
    for spans in windows.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at and n > 0
            at += n
        assert at <= window
    return [sum(n for _, n in s) for s in windows.values()]


def test_query(spark, sf_dir, small):
    filled = hold(packing.op8_lexical_packing(spark, sf_dir).collect(), small, 4096)
    assert sum(n < 4096 for n in filled) <= 4  # one short window a task


@pytest.mark.parametrize("window", [16, 4096])
def test_odd_rows(spark, odd, window):
    found = packing.packed(odd, WORDS, 2, window=window, with_ids=True).collect()
    filled = hold(found, [(r.doc_id, r.text) for r in odd.collect()], window)
    assert sum(n < window for n in filled) <= 4
    assert all(len(p.ids) == p.length for p in found)


def test_empty_table(spark, empty):
    assert packing.packed(empty, WORDS, 2).collect() == []


def test_neighbours_are_those_of_bm25():
    rng = np.random.default_rng(3)
    docs = [rng.zipf(1.4, rng.integers(5, 40)) % 60 for _ in range(50)]
    df = np.zeros(60)
    for d in docs:
        df[list(set(d.tolist()))] += 1
    idf = np.log(1 + (50 - df + 0.5) / (df + 0.5))
    mean = sum(map(len, docs)) / 50
    shard = packing.Shard(docs, idf, mean)

    def weight(t, d):
        tf = Counter(docs[d].tolist())[t]
        return idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean)) if tf else 0.0

    for seed in range(10):
        query = sorted(set(docs[seed].tolist()), key=lambda t: -weight(t, seed))[:packing.QUERY_TERMS]
        score = {d: sum(weight(t, d) for t in query) for d in range(50)}
        got = shard.neighbours(seed).tolist()
        assert set(got) == {d for d in score if score[d] > 0}
        assert all(score[a] >= score[b] - 1e-4 for a, b in zip(got, got[1:])) and math.isfinite(score[got[0]])


def test_neighbours_share_windows(spark):
    """Two kinds of texts with words of their own do not mix before they must."""
    a, b = "alpha beta gamma delta epsilon ", "north south east west centre "
    rows = [(i, (a if i % 2 else b) * 12) for i in range(40)]
    found = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, 2, window=256).collect()
    kinds = defaultdict(set)
    for p in found:
        kinds[p.sequence_id].add(p.doc_id % 2)
    assert sum(len(k) > 1 for k in kinds.values()) <= 2


def test_every_term_of_a_seed_counts():
    """A document that shares only the least heavy of 60 terms is a neighbour."""
    docs = [np.arange(60), np.array([59, 100]), np.array([101])]
    idf = np.linspace(9, 1, 102)
    assert set(packing.Shard(docs, idf, 20.0).neighbours(0).tolist()) == {0, 1}


def test_different_ids():
    """Each id once, as np.unique has them, with scratch left over from another document."""
    place, number = np.full(1 << 16, 7, np.int32), np.arange(2000, dtype=np.int32)
    for seed, n in enumerate((0, 1, 5, 2000, 3)):
        ids = np.random.default_rng(seed).integers(0, 1 << (4 * seed), n).astype("<u2")
        assert np.sort(packing._different(ids, place, number)).tolist() == np.unique(ids).tolist()
