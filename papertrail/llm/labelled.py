"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from papertrail.llm.common import crc_mod, texts

#: Most labelled rows a classifier is fitted on; scores always cover every row.
FIT_ROWS = 20_000


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, text, y of at most ``rows`` labelled documents outside the held-out fold (crc32 of the id mod 5 = 0).

    Rows without id or label are left out; an id with several labels has the largest; which ids are taken goes by a hash
    of the id.  The ids are bounded in number, hence broadcast.  Of rows with one id the text with the smallest hash is taken.
    """
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc_mod("doc_id", 5) != 0)) \
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(label) > 0).cast("double").alias("y")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y") \
        .agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("x")).select("doc_id", "x.text", "y")
