"""Best-fit packing by linear grouping: as few sequences of a fixed length as can be, whole documents wherever they fit.

1. Every text is tokenized; a document longer than a sequence is cut into full ones and a first piece that holds the rest.
   A row per piece goes to a table in the shared folder, with the block (task) that made it and its rank among the pieces
   of its length there.
2. Pieces are counted by length: at most one number per length, whatever the number of documents.  Lengths of more than
   ``large`` of a sequence are put in order and grouped so that all groups hold equally many pieces; each counts as the
   longest of its group.  For these few sizes the best mix of configurations (how many pieces of which groups share a
   sequence) is found by column generation, and its whole parts are kept.
3. The actual lengths take their groups' places, which leaves more room than was planned.  All remaining pieces, the small
   ones and those of fractional configurations, go by falling length to the fullest sequence that still takes them.
   All this is done for runs of equal sequences, so the plan's size is bounded by the number of lengths.
4. A piece's rank among all pieces of its length names its place in the plan: ranks within blocks plus the numbers of
   earlier blocks, added up by Spark per length.

Defined results: a null or empty text has one token, the end; null doc_ids are kept and null; rows with one doc_id are
packed one by one; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from papertrail.llm.byte_coder import byte_coder
from papertrail.llm.coder import tokenizer_path
from papertrail.llm.common import cut, table, texts

WINDOW = 2048
#: A piece is large beyond this share of a sequence, so a configuration holds two at most.
LARGE = 1 / 3
#: Sizes that configurations are made of.
GROUPS = 192
_CUT = "doc_id long, piece int, start long, length long, ids_crc32 long, block long, place long"
_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


@dataclass
class Slot:
    """``each`` pieces of one length per sequence of a run; the run's first sequence holds those from ``rank`` on."""

    length: int
    rank: int
    each: int


@dataclass
class Run:
    """``n`` sequences filled alike."""

    n: int
    room: int
    slots: list[Slot] = field(default_factory=list)

    def split(self, n: int) -> Run:
        """Take the first ``n`` sequences off."""
        head = Run(n, self.room, [Slot(s.length, s.rank, s.each) for s in self.slots])
        self.n -= n
        for s in self.slots:
            s.rank += n * s.each
        return head


def grouped(counts: np.ndarray, least: int, most: int, groups: int) -> list[list[list[int]]]:
    """Pieces of lengths ``least`` to ``most`` in ``groups`` groups of equal numbers, each a list of [length, pieces] from
    the longest down.  Groups with the same longest piece are one."""
    lengths = [l for l in range(most, least - 1, -1) if counts[l]]
    total, out, filled, target = int(sum(counts[l] for l in lengths)), [], 0, 0
    for length in lengths:
        left = int(counts[length])
        while left:
            if filled >= target:
                target = -(-(total * (len(out) + 1)) // groups) if len(out) + 1 < groups else total
                target = max(target, filled + 1)
                out.append([])
            take = min(left, target - filled)
            out[-1].append([length, take])
            filled, left = filled + take, left - take
    merged: list = []
    for group in out:
        if merged and merged[-1][0][0] == group[0][0]:
            merged[-1] += group
        else:
            merged.append(group)
    return merged


def configurations(sizes: np.ndarray, demand: np.ndarray, window: int, rounds: int | None = None) -> list[tuple[np.ndarray, float]]:
    """(pieces of each size, how often) that cover ``demand`` with the fewest sequences, fractions allowed."""
    k = len(sizes)
    basis = np.diag(window // sizes).astype(float)
    inverse, amount = np.diag(1 / np.diag(basis)), demand / np.diag(basis)
    cost = np.ones(k)
    shift = np.arange(window + 1)[None, :] - sizes[:, None]
    shift[shift < 0] = window + 1  # a place that is worth nothing
    for turn in range(rounds or 12 * k + 50):
        dual = cost @ inverse
        surplus = int(np.argmin(dual))
        if dual[surplus] < -1e-9:
            column, price = np.zeros(k), 0.0
            column[surplus] = -1
        else:
            column, price = _best_pattern(sizes, dual, shift, window), 1.0
            if dual @ column <= 1 + 1e-7:
                break
        step = inverse @ column
        ratio = np.full(k, np.inf)
        ok = step > 1e-9
        if not ok.any():
            break
        ratio[ok] = amount[ok] / step[ok]
        out = int(np.argmin(ratio))
        basis[:, out], cost[out] = column, price
        if turn % 50 == 49:
            inverse = np.linalg.inv(basis)
            amount = np.maximum(inverse @ demand, 0)
        else:
            row = inverse[out] / step[out]
            inverse = inverse - np.outer(step, row)
            inverse[out] = row
            amount = np.maximum(amount - step * ratio[out], 0)
            amount[out] = ratio[out]
    return [(np.rint(basis[:, j]).astype(int), float(amount[j])) for j in range(k) if cost[j] and amount[j] > 0]


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, shift: np.ndarray, window: int) -> np.ndarray:
    """The pieces of greatest worth that fit: layer by layer, one piece more."""
    value, taken = np.zeros(window + 2), []
    value[-1] = -np.inf
    for _ in range(window // int(sizes.min())):
        options = value[shift] + worth[:, None]
        pick = options.argmax(axis=0)
        best = options[pick, np.arange(window + 1)]
        better = best > value[:-1] + 1e-12
        if not better.any():
            break
        taken.append(np.where(better, pick, -1))
        value = np.append(np.where(better, best, value[:-1]), -np.inf)
    column, at = np.zeros(len(sizes)), window
    for pick in reversed(taken):
        if pick[at] >= 0:
            column[pick[at]] += 1
            at -= sizes[pick[at]]
    return column


def planned(counts: np.ndarray, window: int, large: float = LARGE, groups: int = GROUPS) -> list[Run]:
    """Runs of equal sequences that hold ``counts[l]`` pieces of every length ``l`` up to ``window``."""
    counts, used = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64)
    runs = []

    def take(length: int, n: int) -> int:
        first = int(used[length])
        used[length] += n
        counts[length] -= n
        return first

    if counts[window]:
        n = int(counts[window])
        runs.append(Run(n, 0, [Slot(window, take(window, n), 1)]))
    classes = grouped(counts, int(window * large) + 1, window - 1, groups)
    if classes:
        sizes = np.array([g[0][0] for g in classes])
        left = np.array([sum(n for _, n in g) for g in classes])
        for column, amount in sorted(configurations(sizes, left.astype(float), window), key=lambda x: -x[1]):
            there = np.flatnonzero(column)
            n = min(int(amount + 1e-6), int((left[there] // column[there]).min()))
            left[there] -= n * column[there]
            places = [g for g in there for _ in range(column[g])]
            if n:
                runs += _substituted(n, window, [_first(classes[g], n, take) for g in places])
    return best_fit(counts, runs, window, take)


def _first(group: list[list[int]], n: int, take: Callable[[int, int], int]) -> list[tuple[int, int, int]]:
    """The next ``n`` pieces of a group as (length, rank, pieces)."""
    out = []
    while n:
        length, there = group[0]
        m = min(n, there)
        out.append((length, take(length, m), m))
        n -= m
        group[0][1] -= m
        if m == there:
            del group[0]
    return out


def _substituted(n: int, window: int, places: list[list[tuple[int, int, int]]]) -> list[Run]:
    """``n`` sequences of one configuration, as runs whose places hold pieces of one length each."""
    ends = sorted({int(e) for place in places for e in np.cumsum([m for _, _, m in place])})
    runs, first = [], 0
    for end in ends:
        run = Run(end - first, window)
        for place in places:
            at = 0
            for length, rank, m in place:
                if at <= first < at + m:
                    run.slots.append(Slot(length, rank + first - at, 1))
                    run.room -= length
                at += m
        runs.append(run)
        first = end
    return runs


def best_fit(counts: np.ndarray, runs: list[Run], window: int, take: Callable[[int, int], int]) -> list[Run]:
    """All pieces left in ``counts``, longest first, each into the fullest sequence that takes it or a new one."""
    done, by_room = [r for r in runs if not r.room], {}
    for r in runs:
        if r.room:
            by_room.setdefault(r.room, []).append(r)
    rooms = sorted(by_room)
    for length in range(window, 0, -1):
        left = int(counts[length])
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = window // length
                opened = Run(-(-left // each), window)
                room = window
            else:
                room = rooms[at]
                opened = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
                each = room // length
            full, rest = divmod(left, each)
            # A sequence takes one piece after the other: having taken one, it is the fullest that takes the next.
            for n, k in ((min(full, opened.n), each), (1, rest if full < opened.n else 0)):
                if n and k:
                    run = opened.split(n)
                    run.slots.append(Slot(length, take(length, n * k), k))
                    run.room -= k * length
                    left -= n * k
                    if run.room:
                        if run.room not in by_room:
                            insort(rooms, run.room)
                        by_room.setdefault(run.room, []).append(run)
                    else:
                        done.append(run)
            if opened.n:
                if room not in by_room:
                    insort(rooms, room)
                by_room.setdefault(room, []).append(opened)
    return done + [r for some in by_room.values() for r in some]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int, with_ids: bool) -> DataFrame:
    """One row per piece, numbered within its task (block) and length."""
    def encode(batches):
        coder, block = byte_coder(tokenizer), uuid.uuid4().int >> 65
        places = np.zeros(window + 1, np.int64)
        for batch in batches:
            rows, ids, size = [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                x = np.append(coder.encode(text), end_id).astype("<u4")
                first = len(x) % window or window
                for piece, end in enumerate(range(first, len(x) + 1, window)):
                    start = max(end - window, 0) if piece else 0
                    part = x[start:end]
                    rows.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes()), block, int(places[len(part)])))
                    places[len(part)] += 1
                    if with_ids:
                        ids.append(part.astype(np.int32))
                        size += len(part)
                    if len(rows) >= 10_000 or size >= 1 << 20:
                        yield _batch(rows, ids, with_ids)
                        rows, ids, size = [], [], 0
            if rows:
                yield _batch(rows, ids, with_ids)

    return texts(docs).mapInArrow(encode, _CUT + (", ids array<int>" if with_ids else ""))


def _batch(rows: list[tuple], ids: list[np.ndarray], with_ids: bool) -> pa.RecordBatch:
    arrays = [pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(zip(*rows))]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "block", "place"]
    if with_ids:
        arrays, names = [*arrays, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
    return pa.RecordBatch.from_arrays(arrays, names)


def slots(runs: list[Run]) -> dict[str, np.ndarray]:
    """The plan as arrays in order of (length, first rank): where each rank of a length goes."""
    rows, sequence = [], 0
    for run in runs:
        offset = 0
        for s in run.slots:
            rows.append((s.length << _RANK_BITS | s.rank, sequence, s.each, offset))
            offset += s.length * s.each
        sequence += run.n
    table_ = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("key", "sequence", "each", "offset"), table_.T.copy()))


#: A piece's length and its rank in one number; ranks of a length stay below 2^47 and lengths below 2^16.
_RANK_BITS = 47


def packed(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, with_ids: bool = False,
           large: float = LARGE, groups: int = GROUPS) -> DataFrame:
    """One row per piece with its sequence and place there; ``with_ids`` adds the piece's token ids as an array."""
    spark = docs.sparkSession
    made = cut(pieces(docs, tokenizer, end_id, window, with_ids), "pieces")
    held = made.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut(held.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "ranks")
    totals = ranked.groupBy("length").agg(F.sum("n").alias("n")).toArrow()  # at most one row per length
    counts = np.zeros(window + 1, np.int64)
    counts[totals.column("length").to_numpy()] = totals.column("n").to_numpy()
    sent = spark.sparkContext.broadcast(slots(planned(counts, window, large, groups)))  # some rows per length

    def place(batches):
        plan = sent.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            key = length << _RANK_BITS | rank
            at = np.searchsorted(plan["key"], key, side="right") - 1
            behind, each = key - plan["key"][at], plan["each"][at]
            out = {"sequence_id": pa.array(plan["sequence"][at] + behind // each),
                   "offset": pa.array(plan["offset"][at] + behind % each * length)}
            names = _NAMES[:5] + list(out) + _NAMES[7:] * with_ids
            yield pa.RecordBatch.from_arrays([out[c] if c in out else batch.column(c) for c in names], names)

    return made.join(ranked.select("length", "block", "base"), ["length", "block"]) \
        .withColumn("rank", F.col("base") + F.col("place")) \
        .mapInArrow(place, _PACKED + (", ids array<int>" if with_ids else ""))


_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)
