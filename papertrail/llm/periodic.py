"""Periodic runs in the words of a text, found as maximal pairs of the LCP-interval tree.

A run of words [b, e) with smallest period q and length of at least ``exponent * q`` is the same thing as a pair of places
b < b + q whose longest common extension is e - b - q words long, with different words to the left (or none): a maximal
pair whose distance is at most 1 / (exponent - 1) of its length.  So maximal pairs are enumerated, and nothing is extended:

1. A text's words become numbers, and suffixes are put in groups by their first words: first ``seed`` words at once (no
   pair of a run is shorter), then twice as many in each round, of those suffixes only that are not yet alone.  What is
   alone after the first round belongs to no run; most texts end here.
2. Common prefixes of neighbours in that order are measured in text order, each starting from the one before less a word.
3. The LCP-interval tree is walked from its leaves.  A node keeps its places in text order together with their left words.
   When two children meet, each place of the smaller is looked up among the places of the larger, and its nearest ones
   to both sides with another left word make a maximal pair of the node's length.  Farther ones need no look: between
   places so near that they overlap by most of their length all places are whole periods apart, the ones next to each
   other give the smallest period, and those of the same left word are not maximal.
4. Pairs of one stretch differ by multiples of its period; the smallest is kept.

A place moves to a larger list at most log2(n) times, so a text of n words takes O(n log n) look-ups.

Defined results: a null or empty text has no words and no runs; null and repeated doc_ids keep a row each; an empty table
gives no rows; further columns are carried through if named in ``carry``.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from papertrail.llm.common import table

#: A run holds its period at least this often, and at least so many words.
EXPONENT, SHORTEST = 4, 6
_RUN = "struct<start:long, length:long, period:long>"
_FOUND = f"n_words long, runs array<{_RUN}>, strongest {_RUN}, collapsed string"
#: Bytes of text after which found rows are handed on.
_PASS_ON = 4 << 20


def numbered(words: list) -> np.ndarray:
    """Each word's number, from 1 in order of first use."""
    number = dict(zip(dict.fromkeys(words), range(1, len(words) + 1)))
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def _ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Place of each pair in the order of pairs, equal pairs having the same."""
    return np.unique(first * (int(second.max()) + 1) + second, return_inverse=True)[1]


def seeded(ids: np.ndarray, seed: int) -> np.ndarray:
    """Rank of each suffix by its first ``seed`` words; 0 stands behind the end."""
    n, rank = len(ids), ids
    padded = np.concatenate([ids, np.zeros(seed, np.int64)])
    width = int(ids.max()).bit_length() + 1
    if width * seed <= 62:  # all words in one number
        key = np.zeros(n, np.int64)
        for j in range(seed):
            key = key << width | padded[j:j + n]
        return np.unique(key, return_inverse=True)[1]
    for j in range(1, seed):
        rank = _ranks(rank, padded[j:j + n])
    return rank


def repeated_suffixes(ids: np.ndarray, seed: int) -> np.ndarray:
    """Suffixes that share their first ``seed`` words with another one, such that those sharing any longer prefix are together."""
    n, rank = len(ids), seeded(ids, seed)
    size = np.bincount(rank)
    open_ = np.flatnonzero(size[rank] > 1)
    if not len(open_):
        return open_
    # A group's rank is the number of suffixes before it, so splitting one leaves the others' ranks alone.
    rank = np.append((np.cumsum(size) - size)[rank], -1)
    order, length = open_[np.argsort(rank[open_], kind="stable")], seed
    live = np.arange(len(order))  # places of ``order`` whose suffix is not alone yet
    while len(live):
        at = order[live]
        group, behind = rank[at], rank[np.minimum(at + length, n)]
        turn = np.lexsort((behind, group))
        at, group, behind = at[turn], group[turn], behind[turn]
        order[live] = at
        edge = np.append(True, (group[1:] != group[:-1]) | (behind[1:] != behind[:-1]))
        first_of_group = np.append(True, group[1:] != group[:-1])
        place = np.arange(len(at))
        start = place[first_of_group][np.cumsum(first_of_group) - 1]
        rank[at] = group + place[edge][np.cumsum(edge) - 1] - start
        part = np.cumsum(edge) - 1
        live = live[np.bincount(part)[part] > 1]
        length *= 2
    return order


def common_prefixes(ids: np.ndarray, order: np.ndarray, seed: int) -> list[int]:
    """Length of the common prefix of each suffix of ``order`` with the one before it."""
    n, words = len(ids), memoryview(ids)
    before = dict(zip(order[1:].tolist(), order[:-1].tolist()))
    length, last, found = 0, -2, {}
    for i in np.sort(order).tolist():
        # A prefix shorter than the seed may belong to a suffix that is not in the order.
        length = length - (i - last) if length - (i - last) >= seed else 0
        last = i
        j = before.get(i)
        if j is None:
            length = 0
            continue
        top = n - max(i, j)
        while length < top and words[i + length] == words[j + length]:
            length += 1
        found[i] = length
    return [0, *(found[i] for i in order[1:].tolist())]


def maximal_pairs(ids: np.ndarray, order: np.ndarray, seed: int, exponent: int) -> dict[tuple[int, int], int]:
    """(start, length) -> smallest distance of the maximal pairs whose distance is at most 1 / (exponent - 1) of their length."""
    left = memoryview(np.append(ids, 0))  # left[i - 1] of place 0 is 0, which is no word
    found: dict[tuple[int, int], int] = {}

    def meet(a: list[int], b: list[int], length: int) -> list[int]:
        small, large = (a, b) if len(a) < len(b) else (b, a)
        reach = length // (exponent - 1)
        for x in small:
            k = bisect_left(large, x)
            for i, j in ((large[k - 1] if k else x, x), (x, large[k] if k < len(large) else x)):
                d = j - i
                if 0 < d <= reach and left[i - 1] != left[j - 1]:
                    if d < found.get((i, length + d), d + 1):
                        found[i, length + d] = d
        if len(small) * 8 < len(large):
            for x in small:
                insort(large, x)
        else:
            large += small
            large.sort()
        return large

    stack: list[tuple[int, list[int]]] = []
    prefixes = common_prefixes(ids, order, seed)
    prefixes.append(0)
    for at, x in enumerate(order.tolist()):
        here, following = [x], prefixes[at + 1]
        while stack and stack[-1][0] > following:
            length, places = stack.pop()
            here = meet(places, here, length)
        if following >= seed:
            if stack and stack[-1][0] == following:
                here = meet(stack.pop()[1], here, following)
            stack.append((following, here))
    return found


def word_runs(words: list, exponent: int = EXPONENT, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    if len(words) < shortest:
        return []
    # The pair of a run is its length less its period: at least shortest - shortest // exponent, for any period.
    seed = min(max((exponent - 1) * q, shortest - q) for q in range(1, shortest + 1))
    ids = numbered(words)
    order = repeated_suffixes(ids, seed)
    pairs = maximal_pairs(ids, order, seed, exponent) if len(order) else {}
    return sorted((start, length, period) for (start, length), period in pairs.items() if length >= shortest)


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; ties: the smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without what repeats: each run keeps its first period, unless another run drops it."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def periodic_runs(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), exponent: int = EXPONENT,
                  shortest: int = SHORTEST) -> DataFrame:
    """``carry``, n_words, runs, the strongest run, and the text with every run collapsed to one period (words joined by
    one space)."""
    narrow = docs.select(*(F.col(c) for c in carry), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))

    def find(batches):
        for batch in batches:
            first, rows, size = 0, [], 0
            for at, value in enumerate(batch.column("_text").to_pylist()):
                words = value.encode().split()  # blank, tab, line feed, vertical tab, form feed, carriage return
                runs = word_runs(words, exponent, shortest)
                rows.append((len(words), runs, strongest(runs), b" ".join(collapsed(words, runs)).decode()))
                size += len(value)
                if size > _PASS_ON:
                    yield _rows(batch.slice(first, len(rows)), rows, carry)
                    first, rows, size = at + 1, [], 0
            if rows:
                yield _rows(batch.slice(first, len(rows)), rows, carry)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(find, f"{kept}, {_FOUND}" if kept else _FOUND)


_KIND = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _rows(batch: pa.RecordBatch, rows: list[tuple], carry: tuple[str, ...]) -> pa.RecordBatch:
    def run(r):
        return None if r is None else dict(zip(("start", "length", "period"), r))
    found = [pa.array([r[0] for r in rows], pa.int64()), pa.array([[run(x) for x in r[1]] for r in rows], pa.list_(_KIND)),
             pa.array([run(r[2]) for r in rows], _KIND), pa.array([r[3] for r in rows], pa.string())]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(carry))] + found,
                                      [*carry, "n_words", "runs", "strongest", "collapsed"])


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Every tenth document, by its id's crc32, gets a looped tail; a null id leaves the text as it is.
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = docs.withColumn("_w", F.when(h % 10 == 0, words)) \
        .select("doc_id", F.when(F.size("_w") > 0, _looped("_w", F.floor(h / 10).cast("long"))).otherwise(F.col("text")).alias("text"))
    said = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return periodic_runs(docs).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "strongest.start", "strongest.length", "strongest.period",
        F.expr("1000 * strongest.length DIV strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(said, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def _looped(words: str, g: Column) -> Column:
    """Words from place g % n on replaced by a loop of the first of them."""
    n = F.nullif(F.size(words), F.lit(0))
    start = (g % n).cast("int")
    period = (1 + F.floor((n - start) / (3 + g % 8))).cast("int")
    turns = F.ceil((n - start) / period).cast("int")
    loop = F.slice(F.flatten(F.array_repeat(F.slice(words, start + 1, period), turns)), F.lit(1), n - start)
    return F.concat_ws(" ", F.slice(words, F.lit(1), start), loop)
