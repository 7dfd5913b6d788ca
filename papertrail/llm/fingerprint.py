"""Document fingerprints by order min-hash, in DataFrame functions only.

A text's k-mers are runs of ``k`` blank-separated words (a shorter text is one k-mer).  Each k-mer carries the number of
its earlier occurrences, so repeats count.  The hash of k-mer and number falls into one of ``BUCKETS`` parts by its top
bits; of each part the two smallest are kept, put back into text order, and hashed as a tuple.  A fingerprint is the row
of these tuple hashes, one for each part that holds anything.  Moving a passage changes the order in the tuples, so the
likeness (equal tuples over parts that either text fills) follows edit distance where a set sketch would not see it.

Everything within a text is array functions on its row; the only shuffles bring a document together with the one after it.

Defined results: a null or empty text (or one of blanks) has the empty fingerprint, which is wholly like itself; documents
follow each other by falling doc_id, a null id last; rows with one doc_id have the same follower, the row of the next
smaller id whose text hash is smallest; a single document follows itself; an empty table gives no rows; further columns
are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from papertrail.llm.common import cut, table, texts

WORDS_PER_KMER = 5
BUCKETS, TOP = 64, 58  # a hash's part is its six top bits
_LOWEST = -(1 << 63)
_BLANKS = "[\\x20\\x09-\\x0D]+"
#: Ids that share all but the low bits are ordered together; only one row of each such block meets the others.
BLOCK_BITS = 14


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a lambda's argument is bound, not substituted."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kmers(text: Column, k: int = WORDS_PER_KMER) -> Column:
    """Hashes of the k-mers in text order."""
    return let(F.array_remove(F.split(text, _BLANKS), ""), lambda w: F.slice(
        F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)])),
        F.lit(1), F.greatest(F.size(w) - (k - 1), F.lit(1))))


def _run_starts(s: Column) -> Column:
    """For a sorted array of (h, p): the index at which each element's run of equal h starts."""
    marks = F.transform(s, lambda x, i: F.when((i > 0) & (F.get(s, i - 1)["h"] == x["h"]), F.lit(0)).otherwise(i))
    # Running maximum by doubling: after the step of 2^j an element knows the 2^(j+1) marks up to its own.
    steps = F.filter(F.array(*[F.lit(1 << j) for j in range(30)]), lambda d: d < F.size(s))
    return F.aggregate(steps, marks, lambda seen, d: F.transform(
        seen, lambda v, i: F.greatest(v, F.get(seen, i - d))))


def numbered(h: Column) -> Column:
    """(g, p): hash of each k-mer with its occurrence number, and its place."""
    plain = F.transform(h, lambda x, i: F.struct(F.xxhash64(x, F.lit(0)).alias("g"), i.alias("p")))
    by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    counted = let(by_hash, lambda s: let(_run_starts(s), lambda start: F.transform(
        s, lambda x, i: F.struct(F.xxhash64(x["h"], i - F.get(start, i)).alias("g"), x["p"].alias("p")))))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), plain).otherwise(counted)


def _part(x: Column) -> Column:
    return F.shiftrightunsigned(x["g"], TOP)


def fingerprint(text: Column, k: int = WORDS_PER_KMER) -> Column:
    """Tuple hashes, rising: 6 bits of part, 26 bits of hash."""
    least = lambda s: F.filter(s, lambda x, i: (i < 2) | (_part(F.get(s, i - 2)) != _part(x)))

    def tuple_hash(s, x, i):
        after, before = F.get(s, i + 1), F.get(s, i - 1)
        pair = F.when(x["p"] < after["p"], F.xxhash64(x["g"], after["g"])).otherwise(F.xxhash64(after["g"], x["g"]))
        found = F.when(_part(after) == _part(x), pair).when(_part(before) == _part(x), F.lit(None)) \
            .otherwise(F.xxhash64(x["g"]))
        return F.shiftleft(_part(x), 26).bitwiseOR(found.bitwiseAND((1 << 26) - 1))

    return let(kmers(text, k), lambda h: let(F.sort_array(numbered(h)), lambda g: let(least(g), lambda s: F.filter(
        F.transform(s, lambda x, i: tuple_hash(s, x, i)), lambda v: v.isNotNull()))))


def likeness(a: Column, b: Column) -> Column:
    """Equal tuples over the parts that either fingerprint fills; 1 for two empty ones."""
    parts = lambda x: F.transform(x, lambda v: F.shiftright(v, 26))
    filled = F.size(F.array_union(parts(a), parts(b)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "")


def followers(ids: DataFrame) -> DataFrame:
    """``ids`` (one row per ``k``) with ``next_k``, the next smaller k; after the smallest comes the largest.

    Blocks of ids lie in blocks of blocks, up to the whole range of a long.  Each level is ordered within the blocks of the
    next one only, so no window holds more than 2^BLOCK_BITS rows, whether ids are dense or spread out.
    """
    levels = [ids.withColumn("block", F.col("k")).withColumn("top", F.col("k"))]
    for _ in range(64 // BLOCK_BITS):
        levels.append(levels[-1].groupBy(F.shiftright("block", BLOCK_BITS).alias("block")).agg(F.max("top").alias("top")))
    over = Window.orderBy(F.desc("block"))  # the last level has at most 2^(64 % BLOCK_BITS) rows
    found = levels.pop().withColumn("next_k", F.coalesce(F.lead("top").over(over), F.first("top").over(over)))
    for level in reversed(levels):
        inside = Window.partitionBy("above").orderBy(F.desc("block"))
        below = level.withColumn("above", F.shiftright("block", BLOCK_BITS)).withColumn("inside", F.lead("top").over(inside))
        found = below.join(found.select(F.col("block").alias("above"), F.col("next_k").alias("outside")), "above") \
            .withColumn("next_k", F.coalesce("inside", "outside")).drop("above", "inside", "outside")
    return found.drop("block", "top")


def edited_fingerprints(docs: DataFrame, k: int = WORDS_PER_KMER) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's."""
    keyed = texts(docs).select(F.coalesce("doc_id", F.lit(_LOWEST)).alias("k"), "text") \
        .select("k", F.xxhash64("text").alias("h"), "text")
    ids = cut(keyed.groupBy("k").agg(F.max(F.length("text")).alias("n"), F.min("h").alias("first_h")), "ids")
    ids = cut(followers(ids), "order")
    need = ids.select(F.col("k").alias("for_k"), F.col("next_k").alias("k"), F.floor(F.col("n") / 3).cast("int").alias("want")) \
        .join(ids.select("k", F.col("first_h").alias("h")), "k")
    # Both joins read ``keyed`` dealt out by k alone, so that its texts are shuffled once: the text hash is compared in a
    # form that does not make it a join key.
    heads = keyed.join(need.withColumnRenamed("h", "first_h"), "k").filter(F.col("h").bitwiseXOR(F.col("first_h")) == 0) \
        .select("for_k", F.expr("substring(text, 1, want)").alias("head")) \
        .groupBy("for_k").agg(F.max("head").alias("head"))
    joined = keyed.join(heads.withColumnRenamed("for_k", "k"), "k")
    cut_at = F.floor(F.length("text") / 3).cast("int")
    edited = joined.select("k", "h", "text", F.length("text").alias("n"), F.concat(
        F.substring("text", F.lit(1), F.length("text") - cut_at), F.substring("head", F.lit(1), cut_at)).alias("edited"))
    done = cut(edited.select("k", "h", "n", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                             fingerprint(F.col("text"), k).alias("fp"), fingerprint(F.col("edited"), k).alias("efp")),
               "fingerprints")
    chosen = done.join(ids.select("k", F.col("first_h").alias("h")), ["k", "h"]).groupBy("k").agg(F.first("fp").alias("next_fp"))
    follow = ids.select("k", "next_k")
    near = follow.join(chosen.withColumnRenamed("k", "next_k"), "next_k").select("k", "next_fp")
    return done.join(near, "k").select(
        F.nullif(F.col("k"), F.lit(_LOWEST)).alias("doc_id"), F.col("n").cast("long").alias("n_chars"), "edited_sha256",
        as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
