"""The Jaccard join against all pairs."""

import itertools
import random
import re

import numpy as np
import pytest
from check import compare, oracle_connection
from papertrail.llm import scan, similar

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i:i + k]) for i in range(max(len(w) - k, 0) + 1)) if w else frozenset()


def brute(rows, k=3, percent=90):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        x, y = sets[i], sets[j]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted((str(d), len(s), str(least.get(top(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in similar.near_duplicates(df, **options).collect())


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        words[at:at + 1] = rng.choice([[], [f"e{rng.randrange(10 ** 6)}"], [words[at], f"i{rng.randrange(10 ** 6)}"]])
    return " ".join(words)


@pytest.mark.parametrize("k,percent,rounds", [(3, 90, 3), (5, 80, 3), (3, 90, 0)])
def test_all_pairs(spark, monkeypatch, k, percent, rounds):
    monkeypatch.setattr(similar, "HUB_ROUNDS", rounds)
    rng = random.Random(k * percent)
    rows = []
    for n in (1, 2, 3, 5, 9, 12, 20, 40, 80, 200, 600):
        base = [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
        chain = base
        for _ in range(7):
            rows.append(edited(rng, base, rng.randrange(0, 2 + n // 40)))
            chain = edited(rng, chain, 1 + n // 60).split() or ["x"]  # each near the one before, not the first
            rows.append(" ".join(chain))
    rows += [None, "", " \n", "Same Text here", "same text HERE"]
    rng.shuffle(rows)
    rows = list(enumerate(rows)) + [(None, "same text here"), (3, "a b"), (3, "a b"), (-1, "A B")]
    assert run(spark, rows, shingle=k, percent=percent) == brute(rows, k, percent)


def test_signatures_meet():
    """Any two sets within the bound share a signature."""
    rng = np.random.default_rng(5)
    for trial in range(1500):
        n = int(rng.integers(1, 400))
        x = np.unique(scan.mix(rng.integers(0, 1 << 62, n, dtype=np.uint64)))
        need = -(-90 * 2 * len(x) // 190)
        drop = int(rng.integers(0, len(x) - min(need, len(x)) + 1))
        y = np.unique(np.concatenate([rng.permutation(x)[drop:], scan.mix(rng.integers(0, 1 << 62, int(rng.integers(0, drop + 2)), dtype=np.uint64))]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 90 * (len(x) + len(y) - both):
            assert len(np.intersect1d(similar.signatures(x), similar.signatures(y))), (len(x), len(y), both)


def test_allocation_is_enough():
    for size in (*range(1, 300), 1000, 12345):
        number, low, high = similar.bands(size, 90)
        a, b, spare = similar.scheme(number, low, high, 90)
        most = (high + high * 100 // 90) * 10 // 190
        assert low <= size <= high and 2 * a + b - 2 * spare > most


def test_large_group_of_near_copies(spark):
    """Every copy has an edit of its own, so no two are equal; hubs join them without all pairs."""
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        w = list(base)
        w[i % 120] = f"own{i}"
        rows.append((i, " ".join(w)))
    got = run(spark, rows)
    assert {c for _, _, c in got} == {"0"}


def test_sql(spark, sf_dir):
    assert compare(spark, oracle_connection(sf_dir), sf_dir, similar.op2_ngram_jaccard, similar.SQL).startswith("ok")


def test_odd_and_empty(spark, odd, empty):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in similar.near_duplicates(odd).collect())
    assert got == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert similar.near_duplicates(empty).collect() == []


def test_only_repeated_signatures_go_on(spark, monkeypatch):
    """Before, a bit table of fixed size let others through, more with every document, up to all of them."""
    monkeypatch.setattr(similar, "REPEATED_BITS", 12, raising=False)
    seen = {}
    monkeypatch.setattr(similar, "cut", lambda df, purpose, cut=similar.cut: seen.setdefault(purpose, []).append(cut(df, purpose)) or seen[purpose][-1])
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(200)]
    rows += [(200 + i, rows[i][1] + " more") for i in range(5)] + [(300, rows[0][1])]
    got = run(spark, rows)
    assert {d: c for d, _, c in got if int(d) >= 200} == {**{str(200 + i): str(i) for i in range(5)}, "300": "0"}
    kept = seen["repeated-signatures"][0].groupBy("sig").count()
    assert kept.filter("count = 1").count() == 0 and kept.count() >= 5
    # Any two groups have different members, and a signature's sets are those that have it.
    groups = [frozenset(r.k) for r in seen["signature-groups"][0].groupBy("sig").agg({"key": "collect_set"}).toDF("sig", "k").collect()]
    assert len(groups) == len(set(groups)) and all(len(g) > 1 for g in groups)


def test_packed_signatures():
    rng = np.random.default_rng(3)
    sig = [np.unique(rng.integers(0, 1 << 48, n, dtype=np.uint64)) for n in (1, 700, 40)]
    keys = [5, (1 << 40) - 1, 77]
    batch = similar._packed(sig, keys, 7, 48, 5)
    got = []
    for r in range(batch.num_rows):
        s, k = similar._unpacked(batch.slice(r, 1), 5)
        assert (np.diff(s.astype(np.int64)) >= 0).all() and len({int(x) * 7 >> 48 for x in s}) == 1
        got += zip(s.tolist(), k.tolist())
    assert sorted(got) == sorted((int(x), k) for s, k in zip(sig, keys) for x in s)


@pytest.mark.parametrize("percent", [80, 90])
def test_wide_sketches(spark, percent):
    """No linked pair is lost, also where the numbers of places differ; unrelated pairs are told apart."""
    rng = np.random.default_rng(percent)
    rows, linked = [], []
    for n in (1000, 1025, 2047, 2049, 5000, 16500):
        x = np.unique(scan.mix(rng.integers(0, 1 << 62, n, dtype=np.uint64)))
        for share in (0, 1 - percent / 100, 0.5, 1):
            y = np.unique(np.concatenate([x[int(len(x) * share):], scan.mix(rng.integers(0, 1 << 62, int(len(x) * share * (share > 0.4)), dtype=np.uint64))]))
            both = len(np.intersect1d(x, y))
            linked.append(100 * both >= percent * (len(x) + len(y) - both))
            rows.append((len(rows), (len(x), similar.wide_sketch(x)), (len(y), similar.wide_sketch(y))))
    df = spark.createDataFrame(rows, "i int, x struct<n: long, wide: array<long>>, y struct<n: long, wide: array<long>>")
    kept = {r.i for r in df.filter(similar._may_link_wide("x", "y", percent)).collect()}
    assert {i for i, l in enumerate(linked) if l} <= kept
    assert not [i for i in kept if i % 4 == 3 and len(rows[i][1][1] or []) and len(rows[i][2][1] or [])]
