"""Benchmark decontamination by a prefix-filtered containment join.

A window of an item is the set of its shingles (up to three words each, with their places).  A document contains a
window only if it has every shingle of it, so one shingle is a sufficient prefix for the containment join; the rarest is
taken, by its count over all documents.  Windows with a shingle that no document has drop out.  Documents are read
twice: once to count the items' shingles, once to emit places of prefix shingles, each with the words around it.  Two
bit tables of fixed size keep other shingles out of the shuffle; their false hits end in the join.

The join is on the shingle.  A match must have room for the window (length bound) and the shingle at its place within
(positional bound); then the words are compared one by one, so hits are exact whatever the hashes.

Defined results: a null or empty text has no words and no hits; an item without words has no window; an item with a null
id counts under the empty id; item ids are a set; null and repeated doc_ids keep a row each; with an empty benchmark no
document is hit; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from papertrail.llm import bloom, scan
from papertrail.llm.common import cut, table, utf8

WINDOW, SHINGLE = 10, 3
#: Copies of the (small) prefix index per shingle, so that a passage in very many documents is not one join key.
SPREAD = 16
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per distinct window: words, the ids of its items, and its shingles' hashes in order."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), upper, lower),
                                 F.lit(f"({_WORD})"), F.lit(1))
    cut_up = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("w")) \
        .filter(F.size("w") > 0).select("item", F.explode(F.transform(
            F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1))),
            lambda i: F.slice("w", i, window))).alias("words"))

    def shingled(batches):
        for batch in batches:
            out = []
            for ws in batch.column("words").to_pylist():
                k = min(SHINGLE, len(ws))
                h = scan.hash_words(ws)
                whole = scan.Words(0, 1, h, np.zeros(len(h), np.int64), h, h, h)
                out.append(whole.grams(k)[0].view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("words"), batch.column("items"), pa.array(out, pa.list_(pa.int64()))],
                ["words", "items", "shingles"])

    return cut_up.groupBy("words").agg(F.collect_set("item").alias("items")).mapInArrow(
        shingled, "words array<string>, items array<string>, shingles array<long>")


def _hits(words: scan.Words, sizes: list[int], bits: np.ndarray):
    """(places, hashes) of shingles that may be among the keys of ``bits``."""
    for k in sizes:
        h, whole = words.grams(k)
        at = np.flatnonzero(whole & bloom.test(bits, h)) if len(h) else np.empty(0, np.int64)
        yield at, h[at]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """n_words, n_hit, the sorted ids of contained items, the spans of hits and ``carry`` for every row of documents."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *carry)
    wins = cut(windows(items, window), "benchmark-windows")
    # Shingles have one to three words; most benchmarks have only one of these sizes.
    sizes = sorted(r[0] for r in wins.select(F.least(F.size("words"), F.lit(SHINGLE)).alias("k")).distinct().collect())
    shingles = wins.select(F.explode("shingles").alias("shingle"))
    known = spark.sparkContext.broadcast(bloom.build(shingles, "shingle"))

    def count(batches):
        for batch in batches:
            seen = [h for w in scan.words(*utf8(batch.column("text")), scan.ALNUM) for _, h in _hits(w, sizes, known.value)]
            keys, n = np.unique(np.concatenate(seen or [np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], ["shingle", "n"])

    frequency = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    placed = wins.select("words", "items", F.size("shingles").alias("needed"), F.posexplode("shingles").alias("place", "shingle"))
    rarest = placed.join(frequency, "shingle").groupBy("words", "needed").agg(
        F.count("*").alias("found"), F.min_by(F.struct("shingle", "place"), F.struct("n", "place")).alias("prefix"),
        F.first("items").alias("items"))
    index = cut(rarest.filter("found = needed").select("prefix.*", "words", "items"), "prefix-index")
    prefix = spark.sparkContext.broadcast(bloom.build(index, "shingle"))

    def probe(batches):
        for batch in batches:
            for w in scan.words(*utf8(batch.column("text")), scan.ALNUM):
                n, found = w.counts(), [[] for _ in range(w.n_docs)]
                first = np.concatenate([[0], np.cumsum(n)])
                for at, hashes in _hits(w, sizes, prefix.value):
                    for i, h in zip(at.tolist(), hashes.view(np.int64).tolist()):
                        d = int(w.doc[i])
                        low, high = max(int(first[d]), i - window + 1), min(int(first[d + 1]), i + window)
                        found[d].append(dict(shingle=h, place=i - int(first[d]), before=i - low,
                                             around=[w.text(j) for j in range(low, high)]))
                rows = slice(w.first, w.first + w.n_docs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row")[rows], batch.column("doc_id")[rows], pa.array(n, pa.int64()), pa.array(found, _FOUND),
                     *[batch.column(c)[rows] for c in carry]], ["row", "doc_id", "n_words", "found", *carry])

    schema = spark.createDataFrame([], "row long, doc_id long, n_words long, "
                                       "found array<struct<shingle:long,place:int,before:int,around:array<string>>>").schema
    for c in carry:
        schema.add(docs.schema[c])
    read = cut(docs.select(F.monotonically_increasing_id().alias("row"), *docs.columns).mapInArrow(probe, schema), "prefix-hits")
    places = read.select("row", F.explode("found").alias("f")).select("row", "f.*") \
        .withColumn("salt", F.pmod(F.hash("row"), F.lit(SPREAD)))
    spread = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))).withColumnRenamed("place", "inner")
    matched = places.join(spread, ["shingle", "salt"]).filter(
        (F.col("inner") <= F.col("before"))
        & (F.size("around") - F.col("before") + F.col("inner") >= F.size("words"))
        & (F.slice("around", F.greatest(F.col("before") - F.col("inner"), F.lit(0)) + 1, F.size("words")) == F.col("words")))
    per_row = matched.groupBy("row").agg(
        F.collect_set(F.struct((F.col("place") - F.col("inner")).alias("s"), F.size("words").alias("n"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["s"], x["s"] + x["n"] - 1)))))
    return read.select("row", "doc_id", "n_words", *carry).join(per_row.select(
        "row", "items", hit.cast("long").alias("n_hit"),
        F.array_sort("spans").alias("spans")), "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans", *carry)


_FOUND = pa.list_(pa.struct([("shingle", pa.int64()), ("place", pa.int32()), ("before", pa.int32()),
                             ("around", pa.list_(pa.string()))]))


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g, least(len(w), {WINDOW}) AS n
  FROM b, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT doc_id, i, p.n, item FROM places p JOIN wins USING (g, n)),
per_item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id),
per_word AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT DISTINCT doc_id, i, n FROM hits), unnest(range(i, i + n)) AS t(k) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per_item USING (doc_id) LEFT JOIN per_word USING (doc_id)
"""
