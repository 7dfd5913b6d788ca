"""Quality classifier: a generalised additive model with pairwise interactions.

Every text becomes some twenty figures (lengths, shares of kinds of characters, repetition of words, word triples and
lines).  Each figure is cut into bins at quantiles of the fitting sample.  Training goes round the figures in turn; each
visit fits one shallow tree (two levels) of that figure alone to the current log-loss gradient and adds a small part of
its leaves to the figure's lookup table.  Pairs of figures are then ranked by how much a coarse table of both lowers the
remaining loss, and the best are boosted in the same way with a split on either side.  A score is the sum of table
entries at a text's bins: one vectorised addition per table.

Only the labels outside the held-out fold are used, of at most ``FIT_ROWS`` documents; labels, lang, source and doc_id are
never inputs.

Defined results: a null text is the empty text and has a score like any other; null and repeated doc_ids keep a row each;
without a labelled document the score is 0.5; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from papertrail.llm import scan
from papertrail.llm.common import crc_mod, table, texts, utf8
from papertrail.llm.labelled import FIT_ROWS, fit_sample

FIGURES = ("log_bytes", "log_words", "word_length", "blanks", "upper", "lower", "digits", "non_ascii", "symbols",
           "full_stops", "symbol_words", "symbol_ends", "capital_words", "distinct_words", "adjacent_equal", "top_word",
           "repeated_triples", "repeated_lines", "line_length", "long_words", "one_byte_words")

_BYTE = np.arange(256)
_UPPER, _LOWER = (_BYTE >= 65) & (_BYTE <= 90), (_BYTE >= 97) & (_BYTE <= 122)
_DIGIT, _WIDE = (_BYTE >= 48) & (_BYTE <= 57), _BYTE >= 128
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _WIDE | ~scan.NOT_BLANK | np.isin(_BYTE, [ord(c) for c in ".,;:!?'\"()-"]))
_PUNCTUATION = ~(_UPPER | _LOWER | _DIGIT | _WIDE | ~scan.NOT_BLANK | np.isin(_BYTE, [ord(c) for c in ".,;:"]))
_LINE = _BYTE != 10


def _repeats(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes, most uses of one) by document."""
    distinct, top = np.zeros(n_docs), np.zeros(n_docs)
    if len(h):
        order = np.lexsort((h, doc))
        d, x = doc[order], h[order]
        new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])]))
        np.maximum.at(top, d[new], np.diff(np.append(new, len(x))))
        distinct = np.bincount(d[new], minlength=n_docs).astype(float)
    return distinct, top


def figures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FIGURES per text."""
    out = []
    for w in scan.words(data, offsets, scan.NOT_BLANK):
        first, last = w.first, w.first + w.n_docs
        at = offsets[first:last + 1] - offsets[first]
        raw = data[offsets[first]:offsets[last]]
        size = np.maximum(np.diff(at), 1)

        def share(kind):
            total = np.concatenate([[0], np.cumsum(kind[raw])])
            return np.diff(total[at]) / size

        n = w.counts()
        words = np.maximum(n, 1)
        by_word = lambda mask: np.bincount(w.doc, mask, minlength=w.n_docs) / words
        length = w.end - w.start
        inside = lambda kind: np.diff(np.concatenate([[0], np.cumsum(kind[raw])])[np.stack([w.start, w.end])], axis=0)[0]
        letters = inside(_UPPER | _LOWER | _DIGIT | _WIDE)
        distinct, top = _repeats(w.doc, w.hash, w.n_docs)
        same = np.zeros(len(w.hash))
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        h3, whole = w.grams(3)
        triples, _ = _repeats(w.doc[:len(h3)][whole], h3[whole], w.n_docs)
        lines = next(scan.words(raw, at, _LINE), None) if len(at) > 1 else None
        n_lines = np.zeros(w.n_docs)
        kinds = np.zeros(w.n_docs)
        if lines is not None and lines.n_docs == w.n_docs:
            n_lines = lines.counts()
            kinds, _ = _repeats(lines.doc, lines.hash, w.n_docs)
        out.append(np.stack([
            np.log1p(np.diff(at)), np.log1p(n), by_word(length), share(~scan.NOT_BLANK), share(_UPPER), share(_LOWER),
            share(_DIGIT), share(_WIDE), share(_SYMBOL), share(_BYTE == ord(".")), by_word(letters == 0),
            by_word(_PUNCTUATION[raw[np.maximum(w.end - 1, 0)]] if len(raw) else np.zeros(0)),
            by_word((inside(_UPPER) >= 2) & (inside(_LOWER) == 0)), distinct / words, by_word(same), top / words,
            1 - triples / np.maximum(n - 2, 1) * (n > 2), 1 - kinds / np.maximum(n_lines, 1) * (n_lines > 0),
            np.log1p(size / np.maximum(n_lines, 1)), by_word(length > 20), by_word(length == 1)], axis=1))
    return np.concatenate(out) if out else np.zeros((0, len(FIGURES)))


@dataclass
class Additive:
    """Bin edges by figure, a lookup table by figure, and tables by pair of figures."""

    edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # bin -> coarse bin, by figure
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins, total = self.bins(x), np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            total += t[bins[j]]
        for (a, b), t in zip(self.pairs, self.pair_tables):
            total += t[self.coarse[a][bins[a]], self.coarse[b][bins[b]]]
        return 1 / (1 + np.exp(-total))


def _leaf(g, h, penalty):
    return g / (h + penalty)


def _split(g: np.ndarray, h: np.ndarray, penalty: float, least: float) -> int | None:
    """Best cut of a row of bins, or None."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), gl ** 2 / (hl + penalty) + gr ** 2 / (hr + penalty), -1.0)
    if not len(gain) or gain.max() <= g.sum() ** 2 / (h.sum() + penalty) + 1e-9:
        return None
    return int(gain.argmax()) + 1


def _tree(g: np.ndarray, h: np.ndarray, penalty: float, least: float, levels: int = 2) -> np.ndarray:
    """Leaf values over the bins of a tree of ``levels`` levels."""
    cut = _split(g, h, penalty, least) if levels else None
    if cut is None:
        return np.full(len(g), _leaf(g.sum(), h.sum(), penalty))
    return np.concatenate([_tree(g[:cut], h[:cut], penalty, least, levels - 1),
                           _tree(g[cut:], h[cut:], penalty, least, levels - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray, penalty: float, least: float) -> np.ndarray:
    """One cut along either side of the table; the better order of the two."""
    best, best_gain = None, -np.inf
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        cut = _split(a.sum(1), b.sum(1), penalty, least)
        if cut is None:
            continue
        out, gain = np.empty_like(a), 0.0
        for part in (slice(None, cut), slice(cut, None)):
            row = _tree(a[part].sum(0), b[part].sum(0), penalty, least, 1)
            out[part] = row
            gain += float((row * a[part].sum(0)).sum())
        if gain > best_gain:
            best, best_gain = (out.T if turn else out), gain
    return np.zeros_like(g) if best is None else best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, rounds: int = 150, rate: float = 0.08, n_pairs: int = 8,
        pair_bins: int = 12, pair_rounds: int = 60, penalty: float = 4.0, least: float = 3.0) -> Additive:
    """Cyclic boosting; the arguments are the usual ones of boosted trees."""
    n_figures = x.shape[1]
    if not len(y) or y.min() == y.max():
        prior = (y.sum() + 0.5) / (len(y) + 1)
        return Additive([np.empty(0)] * n_figures, float(np.log(prior / (1 - prior))), [np.zeros(1)] * n_figures)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(n_figures)]
    model = Additive(edges, float(np.log(y.mean() / (1 - y.mean()))), [np.zeros(len(e) + 1) for e in edges])
    b = model.bins(x)
    total = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for j in range(n_figures):
            p = 1 / (1 + np.exp(-total))
            k = len(edges[j]) + 1
            step = rate * _tree(np.bincount(b[j], y - p, k), np.bincount(b[j], p * (1 - p), k), penalty, least)
            model.tables[j] += step
            total += step[b[j]]
    model.coarse = [np.arange(len(e) + 1) * pair_bins // (len(e) + 1) for e in edges]
    small = [model.coarse[j][b[j]] for j in range(n_figures)]
    size = pair_bins * pair_bins

    def sums(a, c, p):
        cell = small[a] * pair_bins + small[c]
        return (cell, np.bincount(cell, y - p, size).reshape(pair_bins, -1),
                np.bincount(cell, p * (1 - p), size).reshape(pair_bins, -1))

    p = 1 / (1 + np.exp(-total))
    gains = []
    for a in range(n_figures):
        for c in range(a + 1, n_figures):
            _, g, h = sums(a, c, p)
            gains.append((float((_pair_tree(g, h, penalty, least) * g).sum()), a, c))
    model.pairs = [(a, c) for gain, a, c in sorted(gains, reverse=True)[:n_pairs] if gain > 0]
    model.pair_tables = [np.zeros((pair_bins, pair_bins)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for k, (a, c) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-total))
            cell, g, h = sums(a, c, p)
            step = rate * _pair_tree(g, h, penalty, least)
            model.pair_tables[k] += step
            total += step.ravel()[cell]
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Additive:
    def measure(batches):
        for batch in batches:
            x = figures(*utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"),
                                              pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    got = fit_sample(docs, labels, "quality", rows).select("doc_id", "text", "y") \
        .mapInArrow(measure, "doc_id long, y double, x array<double>").toArrow().to_pandas() \
        .sort_values("doc_id", kind="stable")  # at most ``rows`` rows
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FIGURES))
    return fit(x, got["y"].to_numpy(float))


def scored(docs: DataFrame, model: Additive, score: str = "score") -> DataFrame:
    """``docs`` with a column of that name added."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    def add(batches):
        for batch in batches:
            values = sent.value.score(figures(*utf8(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], [*batch.schema.names, score])

    docs = docs.withColumn("text", F.col("text").cast("string"))
    return docs.mapInArrow(add, type(docs.schema)(list(docs.schema.fields)).add(score, "double"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(texts(docs), train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score",
                        (F.col("score") >= 0.3).cast("int").alias("predicted"))
