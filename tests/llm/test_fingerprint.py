"""Order min-hash against a plain Python form of it, on Spark's own hashes; the order of followers; no Python in the plan."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from papertrail.llm import fingerprint as P


def hashes(spark, rows):
    """xxhash64 of tuples of strings or longs, as Spark computes it."""
    width = max(map(len, rows), default=1)
    kind = "string" if any(isinstance(x, str) for r in rows for x in r) else "long"
    df = spark.createDataFrame([(i, *r, *[None] * (width - len(r))) for i, r in enumerate(rows)],
                               "i int, " + ", ".join(f"c{j} {kind}" for j in range(width)))
    return [r.h for r in df.select("i", F.xxhash64(*[f"c{j}" for j in range(width)]).alias("h")).orderBy("i").collect()]


def occurrence_hashes(spark, pairs):
    df = spark.createDataFrame([(i, h, o) for i, (h, o) in enumerate(pairs)], "i int, h long, o int")
    return [r.h for r in df.select("i", F.xxhash64("h", "o").alias("h")).orderBy("i").collect()]


def brute(spark, text, k=5):
    import re
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    if not w:
        return []
    grams = [tuple(w[i:i + k]) for i in range(max(len(w) - k, 0) + 1)]
    seen, pairs = Counter(), []
    for h in hashes(spark, grams):
        pairs.append((h, seen[h]))
        seen[h] += 1
    parts = {}
    for p, g in enumerate(occurrence_hashes(spark, pairs)):
        parts.setdefault((g & (2 ** 64 - 1)) >> 58, []).append((g, p))
    chosen = {b: [g for g, _ in sorted(sorted(v)[:2], key=lambda x: x[1])] for b, v in parts.items()}
    order = sorted(chosen, key=lambda b: b - 64 if b >= 32 else b)  # as signed numbers
    return [(b << 26) | (h & (2 ** 26 - 1)) for b, h in zip(order, hashes(spark, [tuple(chosen[b]) for b in order]))]


TEXTS = ["", "   ", "one", "a b c d", "a b c d e", "a b c d e f", " ".join("xyz"[i % 3] for i in range(60)),
         " ".join(str(i % 40) for i in range(400)), "é ü 中文 \n\t x y z q r s", "same " * 300,
         " ".join(random.Random(4).choices("the of and to in is that it was for".split(), k=500))]


def test_against_plain_form(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    got = {r.i: list(r.f) for r in df.select("i", P.fingerprint(F.col("text")).alias("f")).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == brute(spark, t), t[:40]


def followers(rows):
    """doc_id -> (next text, own) for distinct ids."""
    order = sorted(rows, key=lambda r: -r[0])
    return {r[0]: order[(n + 1) % len(order)][1] or "" for n, r in enumerate(order)}


@pytest.mark.parametrize("ids", [[5], [0, 1, 2], [-3, 7, 1 << 14, (1 << 14) - 1, 1 << 30, -(1 << 40), 99]])
def test_edits(spark, ids):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choices("ab é\n", k=rng.randint(0, 40)))) for i in ids]
    got = {r.doc_id: r for r in P.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    after = followers(rows)
    for i, t in rows:
        n = len(t) // 3
        edited = t[:len(t) - n] + after[i][:n]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    by_text = {t: got[i].fingerprint for i, t in rows}
    assert all(got[i].fingerprint == by_text[t] for i, t in rows)


def test_query(spark, sf_dir, small):
    got = {r.doc_id: r for r in P.op10_order_minhash(spark, sf_dir).collect()}
    after = followers(small)
    assert len(got) == len(small)
    for i, t in small:
        n = len(t) // 3
        assert got[i].edited_sha256 == hashlib.sha256((t[:len(t) - n] + after[i][:n]).encode()).hexdigest()
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
    long = [r for r in got.values() if r.n_chars > 1000]
    assert sum(r.near_edited > r.near_next for r in long) > 0.9 * len(long)
    for i, t in small[:5]:
        assert got[i].fingerprint == "".join(f"{v:08x}" for v in brute(spark, t))


def test_order_counts(spark):
    """The same k-mers in another order are less alike for it than a set sketch would say."""
    rng = random.Random(2)
    parts = [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(40)) for _ in range(12)]
    turned = parts[::-1]
    df = spark.createDataFrame([(" ".join(parts), " ".join(turned))], "a string, b string")
    r = df.select(P.fingerprint(F.col("a")).alias("a"), P.fingerprint(F.col("b")).alias("b")).select(
        P.likeness(F.col("a"), F.col("b")).alias("x"), P.likeness(F.col("a"), F.col("a")).alias("same")).first()
    assert r.same == 1.0 and r.x < 0.5


def test_odd_rows(spark, odd, empty):
    rows = P.edited_fingerprints(odd).collect()
    assert len(rows) == odd.count() and {r.fingerprint for r in rows if r.n_chars == 0} == {""}
    assert sum(r.doc_id is None for r in rows) == 1
    assert P.edited_fingerprints(empty).collect() == []


def test_plan_has_no_python(spark, odd):
    plan = P.edited_fingerprints(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("bits", [14, 3])
@pytest.mark.parametrize("ids", [
    [0], [-(1 << 63), (1 << 63) - 1], list(range(-40, 200)),
    [random.Random(i).getrandbits(64) - (1 << 63) for i in range(300)] + list(range(20))])
def test_followers_of_dense_and_spread_ids(spark, monkeypatch, bits, ids):
    monkeypatch.setattr(P, "BLOCK_BITS", bits)
    order = sorted(ids, reverse=True)
    got = P.followers(spark.createDataFrame([(i, -i - 1) for i in ids], "k long, n long"))
    assert got.columns == ["k", "n", "next_k"]
    assert {r.k: (r.next_k, r.n) for r in got.collect()} == {i: (order[(p + 1) % len(order)], -i - 1) for p, i in enumerate(order)}
