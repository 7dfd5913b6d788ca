"""Corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read back as the next one's
documents; all but the last return the columns of ``documents``.  A stage decides by row, also where ids are null or
repeated: rows are told apart by id and text hash, and rows equal in both share a decision (of equal rows that are near
duplicates one stays).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from papertrail.llm import leaks, packing, quality, secret_scan, similar
from papertrail.llm.coder import tokenizer_path
from papertrail.llm.common import cut, table

#: A document stays if the classifier gives it at least this chance of label 1.
QUALITY = 0.3
#: Near duplicates: five-word shingles, a similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def _free(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``docs`` has, in any case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        name = f"_stage_{name}"
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def _hashed(docs: DataFrame, h: str, k: str) -> DataFrame:
    """``docs`` with a hash of the text and the id as text, both without nulls."""
    return docs.withColumn(h, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("\u0000")))) \
        .withColumn(k, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    score, = _free(docs, "score")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, score).filter(F.col(score) >= QUALITY).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; documents without words stay."""
    h, k, copy = _free(docs, "hash", "id", "copy")
    hashed = _hashed(docs, h, k)
    found = similar.near_duplicates(hashed.select("doc_id", "text", h, k), SHINGLE, PERCENT, carry=(h, k)).filter("label IS NOT NULL")
    found = cut(found.select("doc_id", "label", h, k), "duplicates")
    first = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", h, k)).alias("x"))
    rest = found.join(first, "label").filter((F.col(h) != F.col(f"x.{h}")) | (F.col(k) != F.col(f"x.{k}"))) \
        .select(k, h).distinct()
    kept = hashed.join(rest, [k, h], "left_anti")
    # Equal rows: one of them, unless they are empty.
    number = F.row_number().over(Window.partitionBy(k, h).orderBy(F.lit(0)))
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    return kept.withColumn(copy, number).filter((F.col(copy) == 1) | wordless).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    h, k = _free(docs, "hash", "id")
    hashed = _hashed(docs, h, k)
    found = leaks.contamination(hashed.select("doc_id", "text", h, k), table(spark, sf_dir, "benchmark"), carry=(h, k))
    return hashed.join(found.filter("n_hit > 0").select(k, h).distinct(), [k, h], "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind and n_chars brought up to date."""
    out = secret_scan.redacted(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens: one row per piece, with its token ids."""
    return packing.packed(docs, tokenizer_path("word_bpe_49k.json"), end_id=2, with_ids=True)


STAGES = [("quality", keep_good), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_leaks),
          ("secrets", redact_secrets), ("packing", pack)]
#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
