"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded text.

Folding: lower case, compatibility forms and accents removed, look-alike letters of other scripts, and digits or signs
standing for letters next to a letter; ``l`` and ``i`` become one, since ``1`` and ``|`` may mean either.  What is left
are words of letters with one blank between them.  Digits and signs at a word's end may belong to it or not (``a55``,
``idiot$$$``): such a text is also read with all of them folded and with all of them left out, and a word counts if it
matches in any reading outside that reading's exceptions.

The lexicon is learned: words whose log-odds between toxic and other documents (of a bounded labelled sample outside the
held-out fold) are high and significant, with the log-odds as weight.  Word pairs around a lexicon word that the sample
shows mostly in documents that are not toxic become exception phrases; so do phrases the caller gives.  A match inside an
exception phrase does not count.  A logistic fit over the number of matches, their weight, and their weight per word
gives the score.

Defined results: a null or empty text has the score of a text without matches; null and repeated doc_ids keep a row each;
without a labelled document the score is 0.5; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from papertrail.llm.common import crc_mod, cut, table, texts
from papertrail.llm.labelled import FIT_ROWS, fit_sample

# Look-alikes of Latin letters, from the Cyrillic and Greek alphabets.
_LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "и": "u", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ь": "b",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t",
    "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ł": "i", "ø": "o", "đ": "d", "ß": "b",
}
# Digits and signs that stand for letters.
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i"}
_SIGN = re.compile(r"(?<=[^\W\d_])[01345789|](?=[^\W\d_]|[01345789@$|]+[^\W\d_]|\b)|[01345789@$|](?=[01345789@$|]*[^\W\d_])")
_TAIL = re.compile(r"(?<=[^\W\d_])[01345789@$|]+(?![\w@$|])")
_GAP = re.compile(r"[\W\d_]+")


class _Folds(dict):
    def __missing__(self, point: int):
        c = chr(point)
        if point < 128:
            out = "i" if c == "l" else c
        elif unicodedata.category(c) in ("Mn", "Me", "Cf"):
            out = ""
        else:
            plain = "".join(x for x in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(x))
            out = "".join(_LOOK_ALIKES.get(x, "i" if x == "l" else x) for x in plain)
        self[point] = out
        return out


_FOLDS = _Folds()


def _plain(text: str) -> str:
    return text.lower().replace("l", "i") if text.isascii() else text.lower().translate(_FOLDS)


def _words(plain: str) -> str:
    return f" {_GAP.sub(' ', _SIGN.sub(_letter, plain)).strip()} "


def _letter(m: re.Match) -> str:
    return _SIGNS[m[0]]


def fold(text: str) -> str:
    """Words of letters with one blank before, between and after: the first reading."""
    return _words(_plain(text))


def readings(text: str) -> list[str]:
    """``fold``, and if words end in digits or signs, the other readings; all have the same number of words."""
    plain = _plain(text)
    if not _TAIL.search(plain):
        return [_words(plain)]
    folded = _TAIL.sub(lambda m: "".join(map(_SIGNS.__getitem__, m[0])), plain)
    return list(dict.fromkeys(map(_words, (plain, folded, _TAIL.sub("", plain)))))


@dataclass
class Lexicon:
    """Folded words with weights, exception phrases, and the logistic fit (matches, weight, weight per 100 words, 1)."""

    words: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    fit: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def automaton(self):
        import ahocorasick
        found = ahocorasick.Automaton()
        for w, weight in self.words.items():
            found.add_word(f" {w} ", (len(w) + 2, weight))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(found):
            found.make_automaton()
        return found

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.fit, -30, 30)))


def matches(folded: str, automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) of lexicon words outside exception phrases."""
    if not len(automaton):
        return []
    found, excepted = [], []
    for end, (n, weight) in automaton.iter(folded):
        (excepted if weight is None else found).append((end - n + 1, end, weight))
    if excepted:
        # Of the exceptions that begin no later, the one that reaches farthest.
        excepted.sort()
        starts, reach = [s for s, _, _ in excepted], list(accumulate((e for _, e, _ in excepted), max))
        found = [m for m in found if not (k := bisect_right(starts, m[0])) or reach[k - 1] < m[1]]
    return found


def read_matches(texts_read: list[str], automaton) -> list[float]:
    """Weights of the words that match in any reading, each word once, by its first reading that matches."""
    by_word: dict[tuple[int, int], float] = {}
    for text in texts_read:
        found = matches(text, automaton)
        if found and len(texts_read) > 1:
            blanks = [i for i, c in enumerate(text) if c == " "]
            for start, end, weight in found:
                by_word.setdefault((bisect_left(blanks, start), bisect_left(blanks, end)), weight)
        elif found:
            return [weight for _, _, weight in found]
    return list(by_word.values())


def evidence(text: str, automaton) -> list[float]:
    texts_read = readings(text)
    found = read_matches(texts_read, automaton)
    weight, words = sum(found), max(texts_read[0].count(" ") - 1, 1)
    return [float(np.log1p(len(found))), float(np.log1p(weight)), float(np.log1p(100 * weight / words)), 1.0]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - ridge @ w
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, g)
        w = w + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, size: int = 5000, least: int = 4,
          odds: float = 1.5, sure: float = 3.0, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learn the lexicon (at most ``size`` words in ``least`` or more documents) and the fit."""
    sample = cut(fit_sample(docs, labels, "toxic", rows).select("doc_id", "text", "y"), "toxicity-sample")

    def words(batches):
        seen = Counter()
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                seen.update((w, y) for w in set(fold(text).split()))
        yield _counted(seen)

    def pairs_of(lexicon):
        def pairs(batches):
            seen = Counter()
            for batch in batches:
                for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                    ws = fold(text).split()
                    near = {f"{a} {b}" for a, b in zip(ws, ws[1:]) if a in lexicon or b in lexicon}
                    seen.update((p, y) for p in near)
            yield _counted(seen)
        return pairs

    total = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    one, zero = total.get(1.0, 0), total.get(0.0, 0)
    if not one or not zero:
        return Lexicon({}, set(exceptions))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    counted = lambda f: sample.mapInArrow(f, "w string, y double, n long").groupBy("w").agg(
        F.sum(F.when(F.col("y") > 0, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("y") > 0, 0).otherwise(F.col("n"))).alias("b")) \
        .withColumn("odds", F.log(a / (one - F.col("a") + 0.5)) - F.log(b / (zero - F.col("b") + 0.5))) \
        .withColumn("z", F.col("odds") / F.sqrt(1 / a + 1 / b))
    chosen = counted(words).filter((F.col("a") >= least) & (F.col("odds") >= odds) & (F.col("z") >= sure)) \
        .orderBy(F.desc("z"), "w").limit(size).collect()
    lexicon = Lexicon({r.w: r.odds for r in chosen}, {" ".join(fold(p).split()) for p in exceptions})
    lexicon.exceptions |= {r.w for r in counted(pairs_of(set(lexicon.words))).filter(
        (F.col("a") + F.col("b") >= least) & (F.col("odds") <= 0)).orderBy(F.desc("b"), "w").limit(size).collect()}

    def measure(batches):
        automaton = lexicon.automaton()
        for batch in batches:
            x = [evidence(t, automaton) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"),
                                              pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    got = sample.mapInArrow(measure, "doc_id long, y double, x array<double>").toArrow().to_pandas() \
        .sort_values("doc_id", kind="stable")  # at most ``rows`` rows
    lexicon.fit = _logistic(np.array(got["x"].tolist(), float), got["y"].to_numpy(float))
    return lexicon


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.float64()),
                                       pa.array(list(seen.values()), pa.int64())], ["w", "y", "n"])


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score and number of matches of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most a few thousand words

    def add(batches):
        automaton = sent.value.automaton()
        for batch in batches:
            x = np.array([evidence(t, automaton) for t in batch.column("text").to_pylist()], float).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sent.value.score(x)),
                 pa.array(np.rint(np.expm1(x[:, 0])).astype(np.int64))], ["doc_id", "score", "n_matches"])

    return texts(docs).mapInArrow(add, "doc_id long, score double, n_matches long")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches")
