"""Best-fit packing: every piece in one place, few sequences, ids of the tokenizers library."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from papertrail.llm import best_fit
from papertrail.llm.byte_coder import byte_coder
from papertrail.llm.coder import tokenizer_path

BYTES = tokenizer_path("byte_bpe_50k.json")


def library_ids(text, end=0):
    return [*byte_coder(BYTES).tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def hold(found, rows, window):
    """found: rows of the operator; rows: (doc_id, text).  Returns the number of sequences and of ids."""
    want, got, total = defaultdict(list), defaultdict(list), 0
    for i, t in rows:
        ids = library_ids(t)
        first = len(ids) % window or window
        ends = list(range(first, len(ids) + 1, window))
        for k, (a, b) in enumerate(zip([0, *ends], ends)):
            want[i].append((k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
        total += len(ids)
    places = defaultdict(list)
    for p in found:
        got[p.doc_id].append((p.piece, p.start, p.length, p.ids_crc32))
        places[p.sequence_id].append((p.offset, p.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for spans in places.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at and n > 0
            at += n
        assert at <= window
    return len(places), total


def test_query(spark, sf_dir, small):
    n, total = hold(best_fit.op12_best_fit(spark, sf_dir).collect(), small, 2048)
    assert n <= -(-total // 2048) * 1.02 + 1


@pytest.mark.parametrize("window", [16, 100, 2048])
def test_odd_rows(spark, odd, window):
    found = best_fit.packed(odd, BYTES, 0, window=window, with_ids=True).collect()
    hold(found, [(r.doc_id, r.text) for r in odd.collect()], window)
    assert all(len(p.ids) == p.length and zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 for p in found)


def test_empty_table(spark, empty):
    assert best_fit.packed(empty, BYTES, 0).collect() == []


def test_one_length_holds_all(spark):
    """A third of the rows and more in one length, over many tasks."""
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "a b c d e").otherwise(
        F.concat_ws(" ", F.array_repeat(F.lit("x"), F.col("id").cast("int") % 50))).alias("text")).repartition(7)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    n, total = hold(best_fit.packed(docs, BYTES, 0, window=64).collect(), rows, 64)
    assert n <= -(-total // 64) * 1.02 + 1


def plain_best_fit(lengths, window):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(window - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_whole_and_near_the_best(seed):
    rng = np.random.default_rng(seed)
    window = [50, 64, 300, 2048][seed % 4]
    kinds = [rng.integers(1, window + 1, 3000), np.minimum(rng.geometric(3 / window, 2000), window),
             np.repeat(rng.integers(1, window + 1, 5), 500)]
    lengths = kinds[seed % 3]
    counts = np.bincount(lengths, minlength=window + 1)
    runs = best_fit.planned(counts, window)
    seen = defaultdict(list)
    for r in runs:
        assert r.n > 0 and r.room == window - sum(s.length * s.each for s in r.slots) >= 0
        for s in r.slots:
            seen[s.length].append((s.rank, r.n * s.each))
    for length, spans in seen.items():
        at = 0
        for rank, n in sorted(spans):
            assert rank == at
            at += n
        assert at == counts[length]
    assert set(seen) == set(np.flatnonzero(counts))
    assert sum(r.n for r in runs) <= plain_best_fit(lengths.tolist(), window) * 1.02 + 2
    assert len(runs) <= 8 * window  # bounded by lengths, not by pieces


def test_plan_does_not_grow_with_the_pieces():
    rng = np.random.default_rng(1)
    counts = np.bincount(np.minimum(rng.geometric(1 / 400, 20_000), 2048), minlength=2049)
    assert len(best_fit.planned(counts * 10_000, 2048)) <= 2 * len(best_fit.planned(counts * 10, 2048))


def test_few_sizes_are_packed_without_waste():
    """Configurations, not single pieces: 4 + 3 + 3 fill ten, where the largest first alone wastes room."""
    counts = np.zeros(11, np.int64)
    counts[[4, 3]] = 1000, 2000
    runs = best_fit.planned(counts, 10, large=0.2)
    assert sum(r.n for r in runs) == 1000


def test_ids_equal_the_library():
    coder = byte_coder(BYTES)
    assert coder.quick is not None
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 7 == 0)]
    made = [f"a{c}b1{c}2!{c}? {c} {c}x {c}{c} 'l{c} \n{c}\n {c}" for c in points]
    want = coder.tokenizer.encode_batch(made, add_special_tokens=False)
    assert all(coder.encode(t).tolist() == w.ids for t, w in zip(made, want))


@pytest.mark.parametrize("text", ["", " ", "<|endoftext|>", "a<|endoftext|> <|endoftext|>\n", "a" * 70_000, " " * 200_000,
                                  "\n " * 60_000 + "x", "中文" * 9000, "\x00\x1c﻿"])
def test_long_and_special_texts(text):
    assert byte_coder(BYTES).encode(text).tolist() == library_ids(text)[:-1]
