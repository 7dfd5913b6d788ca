"""N-gram Jaccard join by universe partition and the pigeonhole principle, and its connected components.

Texts become sets of hashed word shingles.  Sizes fall into bands so narrow that two linked sets lie in one band or in
neighbouring ones; each band has a scheme for the pairs whose smaller set lies in it.  Linked sets of a scheme differ in
at most H elements, so if the universe of hashes is cut into m segments, some must agree.  A scheme has segments indexed
as they are and segments indexed with their one-deletion neighbourhood (which forgives one element); with ``a`` of the
latter and ``b`` of the former, a + b segments and 2a + b > H suffice.  The allocation is the one of least cost: signatures
written, plus what short segments are likely to cost in chance matches.  Schemes of whole segments get two segments more,
so that a set may leave out one empty segment, which says nothing.

Sets that share a signature are candidates.  Equal sets are one node from the start.  Within a signature's group, every
member is compared with one hub, which is linear in the group; members then in one component need no further look.  A
few rounds take other hubs, as long as they bring links.  Then whatever pairs of a group still lie in different components
are compared, so no link between different components is lost; no pair is looked at twice.  All pairs first pass bounds (sizes;
parity sketches, whose distance never exceeds that of the sets: one of 1024 places, and for larger sets one of about as many places
as they have elements); whole sets are fetched from the texts only for those that remain, and compared exactly.

Signatures meet in one shuffle, packed: shortened ones as differences, each with some bytes of its set's key, both so long that
few meet by chance, which adds candidates and loses none.  What is shuffled grows with the texts, whatever share repeats.

Defined results: a null or empty text, or one of blanks, has no shingles and is its own component; repeated rows are
equal sets and one component; a null id is never the smallest of a component unless all its ids are null; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from papertrail.llm import bloom, scan
from papertrail.llm.common import cut, partitions, table, utf8

SHINGLE, PERCENT = 3, 90
#: Rounds that compare with a hub, before all pairs left in a group are.
HUB_ROUNDS = 3
#: What a match by chance costs, in signatures.
CHANCE = 1000.0
_SKETCH, _SEEN = 1024, 100_000
#: Signatures a task holds before it packs them, and those of one range, which a task counts at once.
_HELD, _RANGE = 500_000, 1_000_000
#: Bits of a shortened signature, and of a shortened key, beyond those that number all of them.
_SIG_SPARE, _KEY_SPARE = 12, 8


def bands(size: int, percent: int) -> tuple[int, int, int]:
    """(number, least, largest) of the band of a set size."""
    number, low = 0, 1
    while True:
        high = max(low, low * 100 // percent)
        if size <= high:
            return number, low, high
        number, low = number + 1, high + 1


def _excess(mean: float, spare: int) -> float:
    """Expected number of empty segments beyond ``spare``, of a Poisson number with that mean."""
    if mean > 30:
        sd = math.sqrt(mean)
        z = (spare - mean) / sd
        return sd * math.exp(-z * z / 2) / math.sqrt(2 * math.pi) + (mean - spare) * 0.5 * math.erfc(z / math.sqrt(2))
    p, below, sum_below = math.exp(-mean), 0.0, 0.0
    for k in range(spare + 1):
        below, sum_below = below + p, sum_below + k * p
        p *= mean / (k + 1)
    return max(mean - sum_below - spare * (1 - below), 0.0)


@lru_cache(maxsize=4096)
def scheme(number: int, low: int, high: int, percent: int) -> tuple[int, int, int]:
    """(segments with one-deletion neighbourhoods, whole segments, empty segments that may be left out)."""
    most = (high + high * 100 // percent) * (100 - percent) // (100 + percent)  # largest difference of linked sets

    def cost(a: int, spare: int) -> float:
        m = a + max(most + 1 - 2 * a, 0) + 2 * spare
        empty = m * math.exp(-low / m)
        return m - a + a * (1 + low / m) + CHANCE * _excess(empty, spare)

    options = [(a, 0) for a in range((most + 2) // 2 + 1)]
    if most:  # whole segments only, with some to spare
        options += [(0, r) for r in range(1, most // 2 + 2)]
    a, spare = min(options, key=lambda x: cost(*x))
    return a, max(most + 1 - 2 * a, 0) + 2 * spare, spare


@lru_cache(maxsize=1 << 16)
def schemes(size: int, percent: int) -> list[tuple[int, tuple[int, int, int]]]:
    """Schemes a set of this size takes part in: its band's, and that of the band below."""
    number, low, high = bands(size, percent)
    found = [(number, scheme(number, low, high, percent))]
    if low > 1:
        below = bands(low - 1, percent)
        found.append((below[0], scheme(*below, percent)))
    return found


@lru_cache(maxsize=1 << 16)
def expected(size: int, percent: int) -> int:
    """About how many signatures a set of this size has."""
    return sum(a + b - spare + a * size // (a + b) for _, (a, b, spare) in schemes(size, percent)) if size else 0


def signatures(shingles: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Signatures (uint64) of a sorted set of hashes."""
    found = []
    mixed = scan.mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    top = shingles >> np.uint64(32)
    for number, (a, b, spare) in schemes(len(shingles), percent):
        m = a + b
        segment = (top * np.uint64(m)) >> np.uint64(32)
        edge = np.searchsorted(segment, np.arange(m + 1, dtype=np.uint64))
        sums = total[edge[1:]] - total[edge[:-1]]
        tag = scan.mix(np.arange(m, dtype=np.uint64) + np.uint64(((number + 1) << 32)))
        whole = scan.mix(sums + tag)
        if spare:
            empty = np.flatnonzero(edge[1:] == edge[:-1])[:spare]
            whole = np.delete(whole, empty)
        found.append(whole)
        for s in range(a):
            inside = slice(edge[s], edge[s + 1])
            found.append(scan.mix(sums[s] - mixed[inside] + tag[s]))
    return np.unique(np.concatenate(found))


def sets(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE):
    """The sorted distinct shingle hashes of each text in turn."""
    for w in scan.words(data, offsets, scan.NOT_BLANK):
        n = w.counts()
        first = np.concatenate([[0], np.cumsum(n)])
        h, _ = w.grams(shingle)
        short = {k: w.grams(k)[0] for k in range(1, shingle) if (n == k).any()}
        for d in range(w.n_docs):
            if n[d] >= shingle:
                yield np.unique(h[first[d]:first[d + 1] - shingle + 1])
            else:
                yield short[int(n[d])][first[d]:first[d] + 1] if n[d] else np.empty(0, np.uint64)


def set_key(shingles: np.ndarray) -> int:
    """64 bits that stand for the set (signed)."""
    h = scan.mix(np.array([scan.mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64))
    return int(h.view(np.int64)[0])


def sketch(shingles: np.ndarray) -> list[int]:
    """Parity of the number of elements at each of 1024 places; two sketches differ in no more bits than the sets do."""
    odd = np.bincount((shingles & np.uint64(_SKETCH - 1)).astype(np.int64), minlength=_SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def wide_sketch(shingles: np.ndarray) -> list[int] | None:
    """As ``sketch``, at least as many places as elements, a power of two; null where 1024 are enough."""
    if len(shingles) <= _SKETCH:
        return None
    places = 1 << (len(shingles) - 1).bit_length()
    odd = np.bincount((shingles & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _may_link(a: str, b: str, percent: int) -> Column:
    """Bounds that two linked sets keep: sizes, and the distance of their sketches."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum((F.bit_count(F.get(f"{a}.sketch", F.lit(i)).bitwiseXOR(F.get(f"{b}.sketch", F.lit(i))))
                 for i in range(_SKETCH // 64)), F.lit(0))
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (apart * (100 + percent) <= (na + nb) * (100 - percent))


def _may_link_wide(a: str, b: str, percent: int) -> Column:
    """The bound by wide sketches; the larger of two is folded to the places of the smaller."""
    low, high = F.least(F.size(f"{a}.wide"), F.size(f"{b}.wide")), F.greatest(F.size(f"{a}.wide"), F.size(f"{b}.wide"))

    def folded(x: str, i: Column) -> Column:
        further = F.when((F.size(f"{x}.wide") == high) & (high > low), F.get(f"{x}.wide", i + low)).otherwise(F.lit(0).cast("long"))
        return F.get(f"{x}.wide", i).bitwiseXOR(further)

    apart = F.aggregate(F.sequence(F.lit(0), low - 1), F.lit(0),
                        lambda d, i: d + F.bit_count(folded(a, i).bitwiseXOR(folded(b, i))))
    # Sizes within their bound differ by less than a factor of two, so do the places.
    known = F.col(f"{a}.wide").isNotNull() & F.col(f"{b}.wide").isNotNull() & (high <= 2 * low)
    return F.when(known, apart * (100 + percent) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - percent)).otherwise(F.lit(True))


def components(edges: DataFrame) -> DataFrame:
    """(key, label): the smallest key of each component of edges (a, b).

    Each step takes the least label of a key's neighbours and then the label of that label, so paths shorten by doubling.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        step = labels.join(near, "key").select("key", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("key").alias("new"), F.col("label").alias("beyond"))
        moved = cut(step.join(jump, "new", "left").select("key", "label", F.least("new", "beyond").alias("new")), "labels")
        changed = moved.filter("new <> label").limit(1).count()
        labels = moved.select("key", F.col("new").alias("label"))
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, label (one per component; null without shingles) and ``carry`` of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *carry)

    def describe(batches):
        for batch in batches:
            n, key, sk, wide, many = [], [], [], [], []
            for s in sets(*utf8(batch.column("text")), shingle):
                n.append(len(s))
                many.append(expected(len(s), percent))
                key.append(set_key(s) if len(s) else None)
                sk.append(sketch(s) if len(s) else None)
                wide.append(wide_sketch(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.int64()),
                 pa.array(sk, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64())), pa.array(many, pa.int64()),
                 *[batch.column(c) for c in carry]],
                ["doc_id", "n", "key", "sketch", "wide", "signatures", *carry])

    schema = spark.createDataFrame([], "doc_id long, n long, key long, sketch array<long>, wide array<long>, signatures long").schema
    for c in carry:
        schema.add(docs.schema[c])
    described = cut(docs.mapInArrow(describe, schema), "shingle-sets")
    groups = _groups(docs.select("text"), described.select("key", "signatures"), shingle, percent)
    nodes = cut(described.join(groups.select("key").distinct(), "key", "left_semi").groupBy("key")
                .agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide")), "nodes")
    fetched: list[DataFrame] = []

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets are similar enough; sets that are not there yet are fetched first."""
        keys = cut(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "wanted-sets")
        lacking = keys
        for there in fetched:
            lacking = lacking.join(there.select("key"), "key", "left_anti")
        lacking = cut(lacking, "wanted-sets")
        if lacking.limit(1).count():
            fetched.append(_sets_of(docs, lacking, shingle))
        held = reduce(DataFrame.union, fetched) if fetched else spark.createDataFrame([], "key long, set array<long>")
        return _similar(pairs, held.join(keys, "key", "left_semi"), percent)

    def with_nodes(pairs: DataFrame, *columns: str) -> DataFrame:
        return pairs.join(nodes.select(F.col("key").alias("a"), F.struct(*columns).alias("x")), "a") \
            .join(nodes.select(F.col("key").alias("b"), F.struct(*columns).alias("y")), "b")

    def within_wide(pairs: DataFrame) -> DataFrame:
        return with_nodes(pairs, "n", "wide").filter(_may_link_wide("x", "y", percent)).select("a", "b")

    def ordered(x: str, y: str) -> list[Column]:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    members, edges = groups, spark.createDataFrame([], "a long, b long")
    labels, looked, turn = spark.createDataFrame([], "key long, label long"), spark.createDataFrame([], "a long, b long"), 0
    while True:
        placed = members.join(labels, "key", "left").select("sig", "key", F.coalesce("label", "key").alias("label"))
        open_ = placed.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("sig")
        members = cut(placed.join(open_, "sig"), "open-groups")
        if not members.limit(1).count():
            break
        last = turn >= HUB_ROUNDS
        if not last:
            hubs = members.groupBy("sig").agg(F.min(F.struct(F.xxhash64("key", F.lit(turn)), "key", "label")).alias("hub"))
            apart = members.join(hubs, "sig").filter("label <> hub.label").select(*ordered("key", "hub.key")).distinct()
            apart = cut(apart.join(looked, ["a", "b"], "left_anti"), "pairs-apart")
            looked = looked.union(apart)
            pairs = with_nodes(apart, "n", "sketch").filter(_may_link("x", "y", percent)).select("a", "b")
        else:
            known = members.join(nodes, "key")
            x, y = (known.select("sig", F.struct("key", "label", "n", "sketch").alias(c)) for c in "xy")
            pairs = x.join(y, (x["sig"] == y["sig"]) & (F.col("x.label") < F.col("y.label")) & _may_link("x", "y", percent)) \
                .select(*ordered("x.key", "y.key")).distinct().join(looked, ["a", "b"], "left_anti")
        new = cut(linked(cut(within_wide(pairs), "pairs")), "links")
        members = members.select("sig", "key")
        if new.limit(1).count():
            edges = edges.union(new)
            labels = components(edges)
        elif not last:
            turn = HUB_ROUNDS - 1  # another hub would bring nothing either: compare all that is left
        if last:
            break
        turn += 1
    own = described.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("least"))
    placed = own.join(labels, "key", "left").select("key", "least", F.coalesce("label", "key").alias("label"))
    least = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = placed.select("key", "label").join(least, "label")
    return described.select("doc_id", "n", "key", *carry).join(ids, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id"))
        .otherwise(F.col("component_id")).alias("component_id"), "label", *carry)


def _each(batches, shingle: int, percent: int):
    """(key, signatures) of the different sets of a task's texts, as far as ``_SEEN`` keys tell them apart."""
    seen: set = set()
    for batch in batches:
        for s in sets(*utf8(batch.column("text")), shingle):
            if len(s) and (k := set_key(s)) not in seen:
                if len(seen) < _SEEN:  # copies beyond that only make work, no difference
                    seen.add(k)
                yield k, signatures(s, percent)


def _groups(docs: DataFrame, described: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(sig, key) of the shortened signatures that several different sets have; of signatures that the same sets have, one.

    ``described``: key and signatures, the number of them, of every text.  A range of signatures is sorted at once, by one task.
    """
    rows_, total = described.agg(F.count("key"), F.coalesce(F.sum("signatures"), F.lit(0))).first()
    ranges = max(partitions(docs.sparkSession), total // _RANGE + 1)
    bits = min(max(total.bit_length() + _SIG_SPARE, 40), 64)
    width = min(max(-(-(rows_.bit_length() + _KEY_SPARE) // 8), 4), 8)
    mask = (1 << 8 * width) - 1

    def pack(batches):
        held, keys, size = [], [], 0
        for key, sig in _each(batches, shingle, percent):
            held.append(sig >> np.uint64(64 - bits))
            keys.append(key & mask)
            size += len(sig)
            if size > _HELD:
                yield _packed(held, keys, ranges, bits, width)
                held, keys, size = [], [], 0
        if held:
            yield _packed(held, keys, ranges, bits, width)

    def meet(group: pa.Table) -> pa.Table:
        sig, key = _unpacked(group, width)
        order = np.argsort(sig, kind="stable")
        sig = sig[order]
        again = sig[1:] == sig[:-1]
        kept = np.append(again, False) | np.append(False, again)
        sig, key = sig[kept], key[order[kept]]
        order = np.lexsort((key, sig))
        sig, key = _distinct(sig[order], key[order])  # copies of a set
        at, n = _runs(sig)
        several = np.repeat(n > 1, n)
        sig, key = sig[several], key[several]
        at, n = _runs(sig)
        if not len(at):
            return pa.table({c: pa.array([], pa.int64()) for c in ("sig", "key", "n", "all1", "all2")})
        all1, all2 = (np.bitwise_xor.reduceat(scan.mix(key + np.uint64(c)), at) for c in (1, 1 << 63))
        # Copies share hundreds of signatures: of groups with the same members one is enough, here and of all ranges.
        order = np.lexsort((all2, all1, n))
        same = (n[order][1:] == n[order][:-1]) & (all1[order][1:] == all1[order][:-1]) & (all2[order][1:] == all2[order][:-1])
        one = np.ones(len(n), bool)
        one[order[1:][same]] = False
        first = np.zeros(len(sig), bool)
        first[at] = True
        chosen = np.repeat(one, n)
        other = ~first[chosen]

        def once(x: np.ndarray) -> pa.Array:
            return pa.array(np.repeat(x, n)[chosen].view(np.int64), mask=other)

        return pa.table({"sig": pa.array(sig[chosen].view(np.int64)), "key": pa.array(key[chosen].view(np.int64)),
                         "n": once(n), "all1": once(all1), "all2": once(all2)})

    rows = cut(docs.mapInArrow(pack, "range int, width int, body binary, keys binary").groupBy("range")
               .applyInArrow(meet, "sig long, key long, n long, all1 long, all2 long"), "repeated-signatures")
    one = rows.filter("n IS NOT NULL").groupBy("n", "all1", "all2").agg(F.min("sig").alias("sig")).select("sig")
    short = F.col("key").bitwiseAND(F.lit(mask if width < 8 else -1).cast("long"))
    keys = described.filter("key IS NOT NULL").select("key").distinct().withColumn("short", short)
    found = rows.join(one, "sig").select("sig", F.col("key").alias("short")).join(keys, "short").select("sig", "key")
    return cut(found, "signature-groups")


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places, lengths) of the runs of equal values."""
    at = np.flatnonzero(np.append(True, values[1:] != values[:-1])[:len(values)])
    return at, np.diff(np.append(at, len(values)))


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs without those that equal the one before."""
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[:len(a)]
    return a[new], b[new]


def _low_bytes(values: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def _from_bytes(raw: bytes, width: int) -> np.ndarray:
    wide = np.zeros((len(raw) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return wide.view("<u8")[:, 0]


def _packed(held: list[np.ndarray], keys: list[int], ranges: int, bits: int, width: int) -> pa.RecordBatch:
    """Signatures of ``bits`` bits by range of their values, with ``width`` bytes of their sets' keys."""
    values = np.concatenate(held)
    order = np.argsort(values)
    owners = _low_bytes(np.repeat(np.array(keys, np.uint64), [len(x) for x in held])[order], width)
    values = values[order]
    place = ((values >> np.uint64(bits - 32)) * np.uint64(ranges)) >> np.uint64(32)
    edge = np.searchsorted(place, np.arange(ranges + 1, dtype=np.uint64))
    rows = []
    for r in np.flatnonzero(np.diff(edge)).tolist():
        part = values[edge[r]:edge[r + 1]]
        steps = np.diff(part)
        size = max(int(steps.max(initial=0)).bit_length() + 7 >> 3, 1)
        rows.append((r, size, part[:1].astype("<u8").tobytes() + _low_bytes(steps, size).tobytes(), owners[edge[r]:edge[r + 1]].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.int32()),
                                       *[pa.array([x[k] for x in rows], pa.binary()) for k in (2, 3)]], ["range", "width", "body", "keys"])


def _unpacked(group: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, keys' low bytes) of a range."""
    sig = [np.cumsum(np.append(np.frombuffer(body[:8], "<u8"), _from_bytes(body[8:], size)), dtype=np.uint64)
           for body, size in zip(group["body"].to_pylist(), group["width"].to_pylist())]
    return np.concatenate(sig), _from_bytes(b"".join(group["keys"].to_pylist()), width)


def _sets_of(docs: DataFrame, keys: DataFrame, shingle: int) -> DataFrame:
    """(key, set) of the given keys, from the texts."""
    wanted = docs.sparkSession.sparkContext.broadcast(bloom.build(keys, "key"))

    def collect(batches):
        seen: set = set()
        for batch in batches:
            held, values, size = [], [], 0
            for s in sets(*utf8(batch.column("text")), shingle):
                if len(s) and (k := set_key(s)) not in seen and bloom.test(wanted.value, np.array([k]).view(np.uint64))[0]:
                    if len(seen) < _SEEN:  # only spares copies of one task; the rest are dropped after the shuffle
                        seen.add(k)
                    held.append(k)
                    values.append(s.view(np.int64))
                    size += len(s)
                    if size > _HELD:
                        yield _set_rows(held, values)
                        held, values, size = [], [], 0
            yield _set_rows(held, values)

    found = docs.select("text").mapInArrow(collect, "key long, set array<long>")
    return cut(found.join(keys, "key", "left_semi").dropDuplicates(["key"]), "sets")


def _set_rows(keys: list[int], values: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.list_(pa.int64()))], ["key", "set"])


def _similar(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(held.select(F.col("key").alias("a"), F.col("set").alias("x")), "a") \
        .join(held.select(F.col("key").alias("b"), F.col("set").alias("y")), "b") \
        .withColumn("both", both).filter((F.size("x") + F.size("y") - F.col("both")) * percent <= F.col("both") * 100) \
        .select("a", "b")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x20\x09-\x0D]+')")
SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g
  FROM d, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS t(i) WHERE len(w) > 0),
sets AS (SELECT doc_id, list(g ORDER BY g) AS g, count(*) AS n FROM s GROUP BY doc_id),
classes AS (SELECT g, n, min(doc_id) AS a FROM sets GROUP BY g, n),
items AS (SELECT a, n, unnest(g) AS x FROM classes),
rare AS (SELECT a, n, x FROM items QUALIFY count(*) OVER (PARTITION BY x) > 1),
links AS (
  SELECT p.a AS a, q.a AS b FROM rare p JOIN rare q ON p.x = q.x AND p.a < q.a
    AND 100 * least(p.n, q.n) >= {PERCENT} * greatest(p.n, q.n)
  GROUP BY p.a, q.a, p.n, q.n HAVING 100 * count(*) >= {PERCENT} * (p.n + q.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, a FROM classes UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
least_of AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(sets.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM d LEFT JOIN sets USING (doc_id) LEFT JOIN classes ON classes.g = sets.g LEFT JOIN least_of ON least_of.a = classes.a
"""
