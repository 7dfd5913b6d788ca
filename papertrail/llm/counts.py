"""Token counts without token ids.

The piece model's merges never reach over the start of a blank run (no piece holds a blank after another character), so
the number of tokens of a text is the sum over its pre-tokens: a run of blanks and the characters up to the next blank.
Pre-tokens are counted per document; each distinct pre-token is given to the library once; the two are joined and summed.

The most frequent ``head`` pre-tokens (a fixed number of short strings, so a bounded broadcast) are joined where the
documents are read, which keeps hot words out of the shuffle; all others meet in a shuffled join, whatever their number.

Defined results: a null or empty text has 0 tokens and 0 bytes; null and repeated doc_ids keep a row each; an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from papertrail.llm.coder import tokenizer_path
from papertrail.llm.common import cut, partitions, table, texts

_RUN = re.compile(" +[^ ]*")
#: Pre-tokens held in the broadcast, and the longest of them in characters: at most 2^18 * 32 * 4 bytes.
HEAD, HEAD_CHARS = 1 << 18, 32
#: Distinct pre-tokens a task gathers before it hands on their counts.
GATHER = 400_000


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first blank (the library puts one before a text)."""
    if not text:
        return []
    text = text.replace("▁", " ")
    parts = text.split(" ")
    return [x[1:] for x in _RUN.findall(" " + text)] if "" in parts else parts


@lru_cache(maxsize=2)
def pieces(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


def count_pieces(path: str, keys: list[str]) -> list[int]:
    """Pieces of each pre-token; one blank alone is a piece, though the library gives none for an empty text."""
    return [len(x) if k else 1 for k, x in zip(keys, pieces(path).encode(keys, num_threads=1))] if keys else []


def vocabulary(docs: DataFrame, model: str) -> DataFrame:
    """(pre_token, uses, n_pieces) over all documents; every distinct pre-token is tokenized once."""
    def gather(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(pre_tokens(text))
                if len(seen) >= GATHER:
                    yield _pairs(seen)
                    seen = Counter()
        yield _pairs(seen)

    def measure(batches):
        for batch in batches:
            keys = batch.column("pre_token").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("pre_token"), batch.column("uses"), pa.array(count_pieces(model, keys), pa.int64())],
                ["pre_token", "uses", "n_pieces"])

    return docs.select("text").mapInArrow(gather, "pre_token string, uses long") \
        .groupBy("pre_token").agg(F.sum("uses").alias("uses")) \
        .mapInArrow(measure, "pre_token string, uses long, n_pieces long")


def frequent(words: DataFrame, head: int) -> DataFrame:
    """The rows with the largest ``uses``, as many as there are down to a power of 1.1 that keeps within ``head`` rows."""
    step = F.floor(F.log(F.col("uses")) / F.log(F.lit(1.1)))
    sizes = sorted(((r.step, r["count"]) for r in words.groupBy(step.alias("step")).count().collect()), reverse=True)
    least, total = None, 0
    for at, n in sizes:
        total += n
        if total > head:
            break
        least = at
    return words.filter(F.lit(False) if least is None else step >= least)


def _pairs(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                      ["pre_token", "uses"])


def token_counts(docs: DataFrame, model: str, limit: int = 4096, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    spark = docs.sparkSession
    docs = texts(docs)
    words = cut(vocabulary(docs, model), "pre-tokens")
    top = frequent(words.filter(F.length("pre_token") <= HEAD_CHARS), head).select("pre_token", "n_pieces").toArrow().to_pandas()
    known = spark.sparkContext.broadcast(dict(zip(top["pre_token"], top["n_pieces"].tolist())))  # at most ``head`` rows

    def split(batches):
        table_ = known.value
        get = table_.get
        for batch in batches:
            sizes, sums, rests, uses = [], [], [], []
            for text in batch.column("text").to_pylist():
                found, rest = 0, {}
                for word in pre_tokens(text):
                    n = get(word)
                    if n is None:
                        rest[word] = rest.get(word, 0) + 1
                    else:
                        found += n
                sizes.append(len(text.encode()))
                sums.append(found)
                rests.append(list(rest))
                uses.append(list(rest.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()),
                 pa.array(rests, pa.list_(pa.string())), pa.array(uses, pa.list_(pa.int64()))],
                ["row", "doc_id", "n_bytes", "known", "rest", "uses"])

    read = cut(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(
        split, "row long, doc_id long, n_bytes long, known long, rest array<string>, uses array<long>"), "frequencies")
    tail = read.select("row", F.explode(F.arrays_zip("rest", "uses")).alias("x")) \
        .select("row", F.col("x.rest").alias("pre_token"), F.col("x.uses").alias("n"))
    summed = tail.join(words.select("pre_token", "n_pieces"), "pre_token") \
        .groupBy("row").agg(F.sum(F.col("n") * F.col("n_pieces")).alias("rest"))
    total = F.col("known") + F.coalesce(F.col("s.rest"), F.lit(0))
    return read.select("row", "doc_id", "n_bytes", "known").join(summed.alias("s"), "row", "left") \
        .select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
