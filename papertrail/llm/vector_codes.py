"""Vector codes: product quantisation with dictionaries of the values of every dimension.

1. Components become integers, floor(4096 * x).  The vectors of a task are kept in blocks; a block holds, for each
   dimension, the sorted distinct integers (its dictionary) and every vector's place in it.  The blocks go to a table in the
   shared folder, so vectors are read and turned into integers once.
2. A vector is cut into ``parts`` consecutive parts.  A part's codebook starts as that part of the ``entries`` vectors with
   the smallest ids.
3. A round: for each dimension of a block, the squared differences of every dictionary value to all entries are tabulated
   once; the distance of a part is then a gather from the table per dimension and a sum.  Each part goes to its nearest
   entry (ties: the lower index).  Entries' sums come from counts of (entry, dictionary place), so values are again met
   once per dictionary, not per vector.  Sums and counts, one row per dimension and entry, are added up by Spark; an entry
   becomes floor(sum / count), and one that no part chose stays.
4. After the last round parts are assigned once more for codes and errors.

What the driver holds is the codebooks, ``entries`` integers per dimension.  Errors summed per label are joined back by
broadcast for labels of more than 1/512 of the rows (so at most 512 of them), by a shuffle for all others.

Defined results: vectors that are null or hold null or non-finite components are dropped; vectors of different lengths
are compressed apart, each length with codebooks of its own; a length that the number of parts does not divide has parts of
the next larger size, and shorter or empty ones at the end; an empty vector has error 0.  Fewer vectors than ``entries``
give as many entries.  Null ids come after all others; rows of one id are ordered by their integers and kept each.  A null
label is a label of its own.  Components beyond +-4096 count as +-4096, so that no sum leaves 64 bits.  An empty table gives
no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from papertrail.llm.common import cut, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest integer of a component; (2 * 2^24)^2 times 2^12 dimensions stay within 64 bits.
LARGEST = 1 << 24
#: Integers in a block: vectors times dimensions; it holds 2^16 vectors at most, so that places are of 16 bits.
BLOCK = 1 << 20
_BLOCKS = "dim int, n int, vec_id array<long>, label array<string>, places binary, sizes array<int>, values binary"
_SUMS = "dim int, at int, entry int, total long, n long"


def edges(dim: int, parts: int) -> list[int]:
    """Borders of the parts."""
    size = -(-dim // parts) if dim else 0
    return [min(i * size, dim) for i in range(parts + 1)]


def kept(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is whole and finite, with it as the double array ``_v``."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x))
    return vectors.filter(F.col(vector).isNotNull() & finite).withColumn("_v", v)


def integers(rows: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(rows * scale), -LARGEST, LARGEST).astype(np.int64)


def blocks(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """Dictionary-coded blocks of vectors of one length."""
    def encode(batches):
        waiting: dict[int, list] = {}
        for batch in batches:
            offsets = batch.column("_v").offsets.to_numpy().astype(np.int64)
            flat = batch.column("_v").values.to_numpy(zero_copy_only=False)
            ids, labels = batch.column("id").to_pylist(), batch.column("label").to_pylist()
            dims = np.diff(offsets)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                x = integers(flat[offsets[rows][:, None] + np.arange(dim)], scale)
                held = waiting.setdefault(dim, [])
                step = min(max(BLOCK // max(dim, 1), 1), 1 << 16)
                for a in range(0, len(rows), step):
                    if held and sum(len(h[0]) for h in held) + min(step, len(rows) - a) > step:
                        yield _block(dim, held)
                        held = waiting[dim] = []
                    part = rows[a:a + step]
                    held.append((x[a:a + step], [ids[i] for i in part], [labels[i] for i in part]))
            # Many lengths at once: blocks need not be full.
            if sum(len(h[0]) * max(d, 1) for d, held in waiting.items() for h in held) > 4 * BLOCK:
                for dim, held in waiting.items():
                    if held:
                        yield _block(dim, held)
                waiting = {}
        for dim, held in waiting.items():
            if held:
                yield _block(dim, held)

    narrow = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), "_v")
    return narrow.mapInArrow(encode, _BLOCKS)


def _block(dim: int, held: list) -> pa.RecordBatch:
    x = np.concatenate([h[0] for h in held])
    places, values = np.empty((dim, len(x)), "<u2"), []
    for d in range(dim):
        found, places[d] = np.unique(x[:, d], return_inverse=True)
        values.append(found)
    packed = np.concatenate(values) if values else np.empty(0, np.int64)
    columns = [[dim], [len(x)], [[i for h in held for i in h[1]]], [[i for h in held for i in h[2]]],
               [places.tobytes()], [[len(v) for v in values]], [packed.astype("<i4").tobytes()]]
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary(), pa.list_(pa.int32()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                      ["dim", "n", "vec_id", "label", "places", "sizes", "values"])


class Block:
    """One row of the table of blocks."""

    def __init__(self, row: dict):
        self.dim, self.n = row["dim"], row["n"]
        self.places = np.frombuffer(row["places"], "<u2").reshape(self.dim, self.n)
        self.values = np.split(np.frombuffer(row["values"], "<i4").astype(np.int64), np.cumsum(row["sizes"])[:-1]) \
            if self.dim else []

    def nearest(self, book: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of the part from dimension ``first`` to ``last``."""
        distance = np.zeros((self.n, book.shape[0]), np.int64)
        for d in range(first, last):
            squares = (self.values[d][:, None] - book[None, :, d]) ** 2
            distance += squares[self.places[d]]
        best = distance.argmin(axis=1)
        return best, distance[np.arange(self.n), best]


def _read(batches) -> Iterator[Block]:
    for batch in batches:
        for row in batch.select(["dim", "n", "places", "sizes", "values"]).to_pylist():
            yield Block(row)


def first_books(vectors: DataFrame, vec_id: str, entries: int, scale: int) -> dict[int, np.ndarray]:
    """Length -> the integers of the ``entries`` vectors with the smallest ids (entry, dimension)."""
    whole = F.transform("_v", lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(F.greatest(
        F.lit(-1.0 * LARGEST), F.least(F.lit(1.0 * LARGEST), x)) * scale))))
    found = vectors.select(F.size("_v").alias("dim"), F.col(vec_id).cast("long").alias("id"), whole.alias("v"))
    order = (F.col("id").asc_nulls_last(), "v")
    # First within parts of the rows: the rank filter runs before each shuffle, so a task hands on no more than ``entries``.
    for keys in (("dim", F.pmod(F.xxhash64("id", "v"), F.lit(64))), ("dim",)):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        found = found.withColumn("rank", rank).filter(F.col("rank") <= entries)
    chosen = found.orderBy("dim", "rank").select("dim", "v").toArrow().to_pylist()
    held = {dim: [r["v"] for r in rows] for dim, rows in groupby(chosen, lambda r: r["dim"])}
    return {dim: np.array(rows, np.int64).reshape(len(rows), dim) for dim, rows in held.items()}


def refined(stored: DataFrame, books: dict[int, np.ndarray], parts: int) -> dict[int, np.ndarray]:
    """One round: every entry becomes the floored mean of the parts nearest to it."""
    sent = stored.sparkSession.sparkContext.broadcast(books)

    def add(batches):
        sums: dict[int, tuple] = {}
        for block in _read(batches):
            book = sent.value[block.dim]
            k = book.shape[0]
            total, count = sums.setdefault(block.dim, (np.zeros((block.dim, k), np.int64), np.zeros((block.dim, k), np.int64)))
            ends = edges(block.dim, parts)
            for first, last in zip(ends, ends[1:]):
                if first == last:
                    continue
                best, _ = block.nearest(book, first, last)
                count[first:last] += np.bincount(best, minlength=k)
                for d in range(first, last):
                    size = len(block.values[d])
                    met = np.bincount(best * size + block.places[d], minlength=k * size).reshape(k, size)
                    total[d] += met @ block.values[d]
        for dim, (total, count) in sums.items():
            k = total.shape[1]
            at, entry = np.divmod(np.arange(dim * k), k)
            used = count.ravel() > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(used.sum(), dim, np.int32)), pa.array(at[used].astype(np.int32)), pa.array(entry[used].astype(np.int32)),
                 pa.array(total.ravel()[used]), pa.array(count.ravel()[used])], ["dim", "at", "entry", "total", "n"])

    summed = stored.select("dim", "n", "places", "sizes", "values").mapInArrow(add, _SUMS).groupBy("dim", "at", "entry") \
        .agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()  # one row per number of the codebooks
    new = {dim: book.copy() for dim, book in books.items()}
    dims, at, entry, total, n = (summed.column(c).to_numpy() for c in ("dim", "at", "entry", "total", "n"))
    for dim in np.unique(dims).tolist():
        here = dims == dim
        new[dim][entry[here], at[here]] = total[here] // n[here]
    sent.unpersist()
    return new


def compressed(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
               entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """(vec_id, label as text, dim, codes, error of every kept row; codebooks by vector length)."""
    whole = kept(vectors, vector)
    books = first_books(whole, vec_id, entries, scale)
    stored = cut(blocks(whole, vec_id, vector, label, scale), "vector-blocks")
    for _ in range(rounds):
        books = refined(stored, books, parts)
    sent = stored.sparkSession.sparkContext.broadcast(books)

    def assign(batches):
        for batch in batches:
            for i, block in enumerate(_read([batch])):
                codes, error = np.zeros((block.n, parts), np.uint8), np.zeros(block.n, np.int64)
                ends = edges(block.dim, parts)
                for p, (first, last) in enumerate(zip(ends, ends[1:])):
                    if first < last:
                        codes[:, p], away = block.nearest(sent.value[block.dim], first, last)
                        error += away
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id")[i].values, batch.column("label")[i].values, pa.array(np.full(block.n, block.dim, np.int32)),
                     pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
                    ["vec_id", "label", "dim", "codes", "error"])

    return stored.mapInArrow(assign, "vec_id long, label string, dim int, codes binary, error long"), books


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with the error summed over the rows of its label.  ``coded`` is read twice, so give a stored table."""
    by_label = cut(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    total = by_label.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") * 512 > total
    hot, cold = by_label.filter(often).drop("n"), by_label.filter(~often).drop("n")
    same = F.col("c.label").eqNullSafe(F.col("t.label"))
    c = coded.alias("c")
    hot_rows = c.join(F.broadcast(hot).alias("t"), same).select("c.*", "label_error")  # at most 512 labels
    rest = c.join(F.broadcast(hot).alias("t"), same, "left_anti")
    cold_rows = rest.join(cold.alias("t"), same).select("c.*", "label_error")
    return hot_rows.unionByName(cold_rows)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib
    coded, books = compressed(table(spark, sf_dir, "embeddings"))
    sums = {}
    for dim, book in books.items():  # entries of a part, then of the next
        ends = edges(dim, PARTS)
        said = ",".join(str(x) for a, b in zip(ends, ends[1:]) for x in book[:, a:b].ravel().tolist())
        sums[dim] = hashlib.sha256(said.encode()).hexdigest()
    digest = F.coalesce(*(F.when(F.col("dim") == dim, F.lit(s)) for dim, s in sums.items())) if sums else F.lit("")
    return label_errors(cut(coded, "vector-codes")).select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


def _sql() -> str:
    """The same by joins and aggregates: each round's assignment and means as tables of their own."""
    def nearest(book: str) -> str:
        return (f"SELECT v.vec_id, v.part, arg_min(b.entry, (d.away, b.entry)) AS entry, min(d.away) AS away FROM v, {book} b, LATERAL (SELECT "
                "list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i])))::BIGINT AS away) d "
                "WHERE b.part = v.part GROUP BY v.vec_id, v.part")
    steps = [
        "WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding))",
        f"v AS MATERIALIZED (SELECT vec_id, p.part, list_slice(x, p.part * (len(x) // {PARTS}) + 1, (p.part + 1) * (len(x) // {PARTS})) AS x "
        f"FROM k, (SELECT unnest(range({PARTS})) AS part) p)",
        f"b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM v "
        f"QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {ENTRIES})"]
    for r in range(ROUNDS):
        steps += [f"a{r} AS MATERIALIZED ({nearest(f'b{r}')})",
                  f"s{r} AS (SELECT v.part, a.entry, u.i, sum(v.x[u.i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM v JOIN a{r} a USING (vec_id, part), "
                  f"LATERAL (SELECT unnest(range(1, len(v.x) + 1)) AS i) u GROUP BY ALL)",
                  f"m{r} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{r} GROUP BY ALL)",
                  f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN m{r} m USING (part, entry))"]
    return ", ".join(steps) + (
        f", z AS MATERIALIZED ({nearest(f'b{ROUNDS}')}), "
        "c AS (SELECT vec_id, string_agg(lpad(to_hex(entry), 2, '0'), '' ORDER BY part) AS code, sum(away)::BIGINT AS error FROM z GROUP BY vec_id) "
        "SELECT vec_id, lower(code) AS code, error, sum(error) OVER (PARTITION BY k.label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' "
        f"ORDER BY part, entry)) FROM b{ROUNDS}) AS codebooks_sha256 FROM c JOIN k USING (vec_id)")


SQL = _sql()
