"""Secret scans: key patterns, and a battery of randomness tests over every other long token.

Patterns give the base spans (kinds ``assign``, ``access``, ``hex``).  The battery looks at each run of 20 or more
characters of ``[A-Za-z0-9+/_=-]``.  Base spans are cut out of a run, the rest is cut at ``=``, and what no alphabet holds
is cut at ``/ +``, at ``- _`` and at all four; of every part that still has 20 characters:

* the encoding is inferred from the characters: decimal, hex, base32, base62 or base64;
* chi-squared test of the alphabet's uniformity, runs test about the alphabet's median, serial correlation of
  neighbours; each gives a p-value for "drawn uniformly from this alphabet", and the smallest of the three, times three,
  must stay above ``keep`` (a text that is not random fails here);
* the rest is held against ordinary text: the ratio of the uniform likelihood to that of the corpus's own letters (a
  histogram of all long runs that fail the battery, of fixed size) is an e-value, whose expectation over ordinary text
  is at most 1.  Candidates are tested in bands of length, and in each band the Benjamini-Hochberg step-up rule for
  e-values over all candidates of the corpus keeps the share of false discoveries below ``rate``.  Longer runs have more
  evidence, and no short one is judged by the threshold of the long.

What passes is a span of kind ``random``; parts that overlap make one span.  All statistics cover every document; what reaches the driver is two tables of
fixed size (characters by encoding; counts by band and rounded log e-value).

Defined results: a null or empty text has no spans and the sha256 of the empty string; null and repeated doc_ids keep a
row each; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from papertrail.llm.common import cut, table, texts

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
                     r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_NO_PAD = re.compile("[^=]+")
_PARTS = tuple(re.compile(x) for x in ("[^/+]+", "[^_-]+", "[^/+_-]+"))
_ALPHABETS = (
    ("decimal", "0123456789"), ("hex", "0123456789abcdef"), ("hex_upper", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_RANKS = {name: {c: i for i, c in enumerate(chars)} for name, chars in _ALPHABETS}
_SETS = [(name, frozenset(chars)) for name, chars in _ALPHABETS]
#: Length bands of the discovery control: 20-23, 24-31, 32-47, 48-95, 96 and more.
_BANDS = (24, 32, 48, 96)
_EVIDENCE = 400  # log e-values are counted in tenths, from 0 to 40


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern spans, in code points, sorted."""
    found = []
    lower = text.lower() if text.isascii() else text
    if not text.isascii() or "pass" in lower or "secret" in lower or "token" in lower or "api" in lower:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def infer(run: str) -> str | None:
    """The smallest alphabet that holds the run."""
    chars = set(run)
    return next((name for name, known in _SETS if chars <= known), None)


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(run: str, encoding: str) -> float:
    """Smallest p-value of the three tests, times three."""
    ranks = _RANKS[encoding]
    k, n = len(ranks), len(run)
    x = np.fromiter((ranks[c] for c in run), np.int64, n)
    chi = float((np.bincount(x, minlength=k) ** 2).sum()) * k / n - n
    # Wilson-Hilferty: the cube root of chi-squared over its degrees of freedom is near normal.
    d = k - 1
    p_chi = _upper(((max(chi, 0) / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)))
    high = x >= k / 2
    a, b = int(high.sum()), n - int(high.sum())
    if a and b:
        runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * a * b / n
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        p_runs = min(1.0, 2 * _upper(max(abs(runs - mean) - 0.5, 0) / spread))
    else:
        p_runs = 2.0 ** (1 - n)
    y = x - (k - 1) / 2
    r = float((y[1:] * y[:-1]).sum()) / max(float((y * y).sum()), 1e-9)
    p_serial = min(1.0, 2 * _upper(abs(r) * math.sqrt(n)))
    return min(1.0, 3 * min(p_chi, p_runs, p_serial))


def parts(run: str) -> list[tuple[int, str, str]]:
    """(start, part, encoding) of what is tested of a run."""
    out = {}
    for piece in _NO_PAD.finditer(run):
        # A piece that mixes the two base64 alphabets: as tokens of either, and of letters and digits alone.
        cuts = [piece] if infer(piece[0].strip("-_/+")) else [
            m for cut_ in _PARTS for m in cut_.finditer(run, piece.start(), piece.end())]
        for m in cuts:
            part = m[0].strip("-_/+")
            if len(part) >= 20 and (encoding := infer(part)):
                out[m.start() + m[0].find(part), part] = encoding
    return [(start, part, encoding) for (start, part), encoding in sorted(out.items())]


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, str, str, float]]:
    """(start, end, run, encoding, p) of the parts of long runs outside base spans."""
    found, at = [], 0
    for m in _RUN.finditer(text):
        start, end = m.span()
        while at < len(taken) and taken[at][2] <= start:
            at += 1
        free, i = [], at
        while i < len(taken) and taken[i][0] < end:
            if taken[i][2] > start:
                free.append((start, taken[i][0]))
                start = taken[i][2]
            i += 1
        for a, z in [*free, (start, end)]:
            if z - a >= 20:
                found += [(a + s, a + s + len(run), run, encoding, battery(run, encoding)) for s, run, encoding in parts(text[a:z])]
    return found


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) spans, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def band(n: int) -> int:
    return sum(n >= b for b in _BANDS)


@dataclass
class Rules:
    """log10 frequency of each character of ordinary text by encoding; least evidence (tenths) by length band."""

    ordinary: dict[str, dict[str, float]]
    least: list[int]
    keep: float

    def evidence(self, run: str, encoding: str) -> int:
        logs = self.ordinary[encoding]
        e = sum(-math.log10(len(logs)) - logs[c] for c in run)
        return int(min(_EVIDENCE, max(0, 10 * e)))

    def holds(self, run: str, encoding: str, p: float) -> bool:
        return p > self.keep and self.evidence(run, encoding) >= self.least[band(len(run))]


def found(docs: DataFrame) -> DataFrame:
    """doc_id, base spans, and candidates of the battery with their p-values, of every text."""
    def find(batches):
        for batch in batches:
            spans, runs = [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                spans.append([dict(start=s, kind=k, end=e) for s, k, e in base])
                runs.append([dict(start=s, end=e, run=r, encoding=c, p=p) for s, e, r, c, p in candidates(text, base)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(spans, _SPAN), pa.array(runs, _CANDIDATE)], ["doc_id", "spans", "runs"])

    return cut(texts(docs).mapInArrow(
        find, f"doc_id long, spans {_SPANS}, runs array<struct<start:int,end:int,run:string,encoding:string,p:double>>"),
        "secret-candidates")


def learn(candidates_: DataFrame, keep: float = 0.001, rate: float = 0.01) -> Rules:
    """Rules from the candidates of all documents."""
    runs = candidates_.select(F.explode("runs").alias("r")).select("r.*")
    # Ordinary text: characters of the runs that failed, by encoding (one row per encoding and character).
    rows = runs.filter(F.col("p") <= keep).select("encoding", F.explode(F.split("run", "")).alias("c")) \
        .filter("c <> ''").groupBy("encoding", "c").count().collect()
    # Without many such runs in an encoding, the letters of all of them stand for ordinary text.
    ordinary: dict[str, dict[str, float]] = {}
    for name, chars in _ALPHABETS:
        own = {r["c"]: r["count"] for r in rows if r["encoding"] == name}
        if sum(own.values()) < 1000:
            own = {}
            for r in rows:
                if r["c"] in _RANKS[name]:
                    own[r["c"]] = own.get(r["c"], 0) + r["count"]
        total = sum(own.values()) + len(chars)
        ordinary[name] = {c: math.log10((own.get(c, 0) + 1) / total) for c in chars}
    rules = Rules(ordinary, [], keep)

    def measure(batches):
        for batch in batches:
            runs_, codes = batch.column("run").to_pylist(), batch.column("encoding").to_pylist()
            e = [rules.evidence(r, c) if p > keep else 0 for r, c, p in zip(runs_, codes, batch.column("p").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([band(len(r)) for r in runs_], pa.int32()), pa.array(e, pa.int32())],
                                             ["band", "e"])

    counts = np.zeros((len(_BANDS) + 1, _EVIDENCE + 1))
    for r in runs.mapInArrow(measure, "band int, e int").groupBy("band", "e").count().collect():  # at most 5 * 401 rows
        counts[r["band"], r["e"]] += r["count"]
    for row in counts:  # step-up rule: the least e with m / (rate * number at or above e) <= 10^e
        m, above = row.sum(), np.cumsum(row[::-1])[::-1]
        fits = [e for e in range(1, _EVIDENCE + 1) if above[e] and 10 ** (e / 10) >= m / (rate * above[e])]
        rules.least.append(min(fits, default=_EVIDENCE + 1))
    return rules


def scan(docs: DataFrame, keep: float = 0.001, rate: float = 0.01) -> DataFrame:
    """doc_id, base spans and random spans of every text: arrays of (start, kind, end)."""
    seen = found(docs)
    rules = learn(seen, keep, rate)

    def choose(batches):
        for batch in batches:
            out = [[dict(start=s, kind=3, end=e) for s, e in joined(
                        [(r["start"], r["end"]) for r in runs if rules.holds(r["run"], r["encoding"], r["p"])])]
                   for runs in batch.column("runs").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("spans"), pa.array(out, _SPAN)], ["doc_id", "base", "random"])

    return seen.mapInArrow(choose, f"doc_id long, base {_SPANS}, random {_SPANS}")


def redacted(docs: DataFrame, keep: float = 0.001, rate: float = 0.01) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; texts without a span stay as they are."""
    rules = learn(found(docs), keep, rate)

    def rewrite(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                if text:
                    base = base_spans(text)
                    spans = base + [(s, 3, e) for s, e in joined(
                        [(s, e) for s, e, *run in candidates(text, base) if rules.holds(*run)])]
                    pieces, at = [], 0
                    for s, k, e in sorted(spans):
                        if e > at:  # what overlaps an earlier span goes with it
                            pieces += [text[at:s], f"<{KINDS[k]}>"] if s >= at else []
                            at = e
                    text = "".join([*pieces, text[at:]]) if spans else text
                out.append(text)
            at = batch.schema.names.index("text")
            yield batch.set_column(at, "text", pa.array(out, pa.string()))

    docs = docs.withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(rewrite, docs.schema)


_SPANS = "array<struct<start:int,kind:int,end:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_CANDIDATE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("run", pa.string()),
                                 ("encoding", pa.string()), ("p", pa.float64())]))


def _joined(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat(
        F.get(names, x["kind"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def summary(scanned: DataFrame) -> DataFrame:
    def count(kind: int):  # a function of two arguments would get the place in the array as the second
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(3)]
    return scanned.select("doc_id", *counts, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"),
                        _joined(F.sort_array(F.concat("base", "random"))).alias("spans"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(scan(table(spark, sf_dir, "documents")))
