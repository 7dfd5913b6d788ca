"""Contamination against a plain search, and against SQL."""

import hashlib
import re

import pytest
from check import compare, oracle_connection
from papertrail.llm import leaks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOW))


def brute(docs, items, window=10):
    wins = [(str(i) if i is not None else "", tuple(w[k:k + window])) for i, t in items if (w := words(t))
            for k in range(max(len(w) - window, 0) + 1)]
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, g in wins:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k:k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    found.add(item)
        out.append((str(i), len(w), len(hit), sorted(found)))
    return sorted(out)


def run(spark, docs, items):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in leaks.contamination(docs, items).collect())


LONG = "one two three four five six seven eight nine ten eleven twelve one two three"


def test_brute(spark):
    items = [(1, LONG), (2, "Short item"), (2, "another text of it"), (None, "no id"), (3, ""), (4, None), (5, "x"),
             (6, "aa aa aa aa aa aa aa aa aa aa aa"), (7, LONG), (8, "é ß-中 q")]
    docs = [(0, None), (1, ""), (2, LONG.upper() + " and " + LONG), (3, "a short ITEM, short-item; no ID"), (4, "aa " * 30),
            (5, LONG[4:]), (6, LONG[:50]), (7, "É ß 中 q é ß 中 q"), (7, "x"), (None, "x y"), (8, "clean words only " * 50),
            (9, "one two three four five six seven eight nine other ten eleven")]
    got = run(spark, spark.createDataFrame(docs, "doc_id long, text string"),
              spark.createDataFrame(items, "item_id long, text string"))
    assert got == brute(docs, items)


def test_odd_and_empty(spark, odd, empty):
    items = spark.createDataFrame([(1, "word word word"), (2, "the same text")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert run(spark, odd, items) == brute(rows, [(1, "word word word"), (2, "the same text")])
    assert run(spark, odd, none) == brute(rows, [])
    assert run(spark, empty, items) == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    assert compare(spark, oracle_connection(path), path, leaks.op3_benchmark_leaks, leaks.SQL).startswith("ok")


def test_digest(spark, sf_dir):
    row = leaks.op3_benchmark_leaks(spark, sf_dir).filter("n_items = 0").first()
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest() and row.contaminated is False
