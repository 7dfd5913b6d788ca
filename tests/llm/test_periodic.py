"""Periodic runs against a comparison of every word with the one a period later."""

import hashlib
import random
import zlib

import pytest

from papertrail.llm import periodic as P


def brute(w, exponent=4, shortest=6):
    best = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            b = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - b >= max(shortest, exponent * q):
                best.setdefault((b, i + q - b), q)
    return sorted((b, n, q) for (b, n), q in best.items())


def made(rng, most):
    n, alphabet = rng.randrange(most), rng.choice([1, 2, 2, 3, 5, 30])
    words = []
    while len(words) < n:
        unit = [str(rng.randrange(alphabet)) for _ in range(rng.randrange(1, 9))]
        words += unit * rng.choice([1, 1, 2, 4, 5, 9])
    return words[:n]


@pytest.mark.parametrize("exponent,shortest", [(4, 6), (2, 2), (2, 7), (3, 5), (5, 1)])
def test_runs(exponent, shortest):
    rng = random.Random(exponent * 100 + shortest)
    for _ in range(600):
        w = made(rng, 90)
        assert P.word_runs(w, exponent, shortest) == brute(w, exponent, shortest), w


def test_long_vocabulary():
    """More words than five of which fit one 64-bit number."""
    rng = random.Random(4)
    w = [str(rng.randrange(9000)) for _ in range(12_000)]
    w = w[:6000] + w[3000:3050] * 5 + w[6000:] + ["x", "y"] * 40
    assert P.word_runs(w) == brute(w)


@pytest.mark.parametrize("words", [["a"] * 200_000, ["a", "b"] * 100_000, [str(i % 30_000) for i in range(200_000)]])
def test_very_long_texts(words):
    q = len(set(words))
    assert P.word_runs(words) == [(0, len(words), q)]
    assert P.collapsed(words, P.word_runs(words)) == words[:q]


def test_every_longer_period_of_a_node():
    """Many places with one word before them and many with others: look-ups stay few, results whole."""
    rng = random.Random(8)
    line = "one two three four five six".split()
    w = [x for i in range(400) for x in ([str(rng.randrange(5))] if i % 3 else []) + line]
    assert P.word_runs(w) == brute(w)


def expected(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute(w)
    drop = {i for b, n_, q in runs for i in range(b + q, b + n_)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{b},{m},{q}\n" for b, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in drop)).hexdigest())


def key(row):
    return tuple(str(x) for x in row)


def test_query(spark, sf_dir, small):
    found = P.op11_periodic_runs(spark, sf_dir)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = [tuple(r) for r in found.collect()]
    assert sorted(got, key=key) == sorted((expected(i, t) for i, t in small), key=key)
    assert sum(r[1] for r in got) > 10


def test_odd_rows(spark, odd, tmp_path):
    extra = odd.unionByName(spark.createDataFrame(
        [(i, "x y z " * (i % 40), None, None, None, None, None) for i in range(1000, 1200)], odd.schema)).repartition(3)
    extra.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in P.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=key) == sorted((expected(r.doc_id, r.text) for r in extra.collect()), key=key)


def test_operator_gives_spans_and_texts(spark):
    docs = spark.createDataFrame([(1, "a b  " * 5 + "\n c", "kept"), (2, None, None)], "runs long, text string, strongest string")
    got = {r.id: r for r in P.periodic_runs(docs.withColumnRenamed("runs", "id"), carry=("id",)).collect()}
    assert got[1].n_words == 11 and [tuple(r) for r in got[1].runs] == [(0, 10, 2)] and got[1].collapsed == "a b c"
    assert got[2].runs == [] and got[2].strongest is None and got[2].collapsed == ""


def test_empty_table(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert P.op11_periodic_runs(spark, str(tmp_path)).collect() == []
