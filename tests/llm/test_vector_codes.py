"""Vector codes against plain integer arithmetic."""

import hashlib
import math

import numpy as np
import pytest

from papertrail.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, error string, n string, code string"


def plain(rows, parts=8, entries=16, rounds=6):
    """rows: (vec_id, vector, label).  -> sorted (vec_id, codes, error), books by length."""
    out, books = [], {}
    by_dim = {}
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole = [max(-(1 << 24), min(1 << 24, math.floor(4096 * float(np.float32(x))))) for x in v]
            by_dim.setdefault(len(v), []).append((i is None, i or 0, whole, label, i))
    for dim, held in by_dim.items():
        held.sort(key=lambda r: r[:3])
        size = -(-dim // parts)
        cuts = [(min(p * size, dim), min((p + 1) * size, dim)) for p in range(parts)]
        book = [[r[2][a:b] for r in held[:entries]] for a, b in cuts]

        def away(x, y):
            return sum((p - q) ** 2 for p, q in zip(x, y))

        def pick(p, x):
            return min(range(len(book[p])), key=lambda e: (away(book[p][e], x), e))

        for _ in range(rounds):
            for p, (a, b) in enumerate(cuts):
                mine = {}
                for r in held:
                    mine.setdefault(pick(p, r[2][a:b]), []).append(r[2][a:b])
                for e, xs in mine.items():
                    book[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
        books[dim] = book
        for r in held:
            codes = [pick(p, r[2][a:b]) for p, (a, b) in enumerate(cuts)]
            out.append((r[4], codes, sum(away(book[p][codes[p]], r[2][a:b]) for p, (a, b) in enumerate(cuts)), r[3], dim))
    return out, books


def key(row):
    return tuple(str(x) for x in row)


def same(coded, books, rows, **options):
    want, plain_books = plain(rows, **options)
    got = [(r.vec_id, list(r.codes), r.error, None if r.label is None else int(r.label), r.dim) for r in coded.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert set(books) == set(plain_books)
    for dim, book in plain_books.items():
        flat = [sum((book[p][e] for p in range(len(book))), []) for e in range(len(book[0]))]
        assert books[dim].tolist() == flat


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()][:]
    want, books = plain(rows)
    labels = {}
    for _, _, error, label, _ in want:
        labels[label] = labels.get(label, 0) + error
    book = next(iter(books.values()))
    sha = hashlib.sha256(",".join(str(x) for part in book for entry in part for x in entry).encode()).hexdigest()
    got = {(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in V.op13_vector_codes(spark, sf_dir).collect()}
    assert got == {(i, "".join(f"{c:02x}" for c in codes), error, labels[label], sha) for i, codes, error, label, _ in want}


def odd_rows():
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).round(2).tolist(), int(i % 3)) for i in range(60)]
    rows += [(100 + i, rng.normal(size=5).tolist(), None) for i in range(20)] + [(200, [], 1), (201, [], None), (202, [0.5], 1)]
    rows += [(300, None, 1), (301, [None] * 16, 1), (302, [float("nan")] * 16, 1), (303, [1.0] * 15 + [float("inf")], 1),
             (304, [1.0] * 15 + [float("-inf")], 2), (305, [3e38] * 16, 2), (306, [-3e38] * 16, 2), (307, [1e-30, -1e-30] * 8, 2)]
    rows += [(None, [0.25] * 16, 1), (None, [0.125] * 16, None), (7, [0.1] * 16, 1), (7, [0.1] * 16, 1), (-4, [-0.0] * 16, 9)]
    return rows


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_odd_rows(spark, block, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", block)
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(5)
    coded, books = V.compressed(df)
    same(coded, books, rows)


def test_parts_entries_and_rounds_are_parameters(spark):
    rows = [r for r in odd_rows() if r[1] is None or len(r[1]) == 16]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    coded, books = V.compressed(df, parts=3, entries=40, rounds=2)
    same(coded, books, rows, parts=3, entries=40, rounds=2)


def test_label_errors_of_frequent_and_rare_labels(spark):
    rows = [(i, "often" if i % 3 else (None if i % 2 else f"rare{i}"), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, label string, error long")
    want = {}
    for _, label, error in rows:
        want[label] = want.get(label, 0) + error
    assert {(r.vec_id, r.label_error) for r in V.label_errors(df).collect()} == {(i, want[label]) for i, label, _ in rows}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert V.op13_vector_codes(spark, str(tmp_path)).collect() == []
    spark.createDataFrame([(1, None, 1, "", "", "")], SCHEMA).write.parquet(str(tmp_path / "b/embeddings.parquet"))
    assert V.op13_vector_codes(spark, str(tmp_path / "b")).collect() == []
