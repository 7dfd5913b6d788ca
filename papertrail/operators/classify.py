"""Document type from the file name, with a confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from papertrail import fixed_values as V
from papertrail.functions import names as N
from papertrail.operators.admission import resolve_mime


def type_by_name(lowered: Column, keywords: list[tuple[str, list[str]]] | None = None) -> Column:
    """First keyword list with a word contained in the lower-cased name."""
    result = F.when(F.lit(False), F.lit(None).cast("string"))
    for doc_type, words in keywords or V.NAME_KEYWORDS:
        test = F.lit(False)
        for word in words:
            test = test | F.contains(lowered, F.lit(word))
        result = result.when(test, doc_type)
    return result.otherwise(V.DEFAULT_TYPE)


def type_confidence(doc_type: Column, mime: Column) -> Column:
    return F.least(
        F.lit(0.5) + F.when(mime.isin(V.SUPPORTED_MIME_TYPES), 0.2).otherwise(0.0)
        + F.when(doc_type != V.DEFAULT_TYPE, 0.2).otherwise(0.0)
        + F.when(mime == "application/pdf", 0.1).otherwise(0.0), F.lit(1.0))


def classify(df: DataFrame, name: str = "original_filename", size: str = "file_size",
             declared: str = "content_type", content: str | None = None,
             rejected: Column | None = None,
             keywords: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """Adds document_type, confidence, mime_type, file_extension, is_supported and metadata.

    Rows for which ``rejected`` holds get the safe default.
    """
    bad = F.lit(False) if rejected is None else rejected
    safe, head = F.col("_safe"), F.col(content).cast("binary") if content else None
    df = df.withColumn("_safe", N.check_name(F.col(name))["sanitized"]).withColumn(
        "_lower", F.lower("_safe"))
    df = df.withColumn("mime_type", F.when(bad, V.DEFAULT_MIME).otherwise(
        resolve_mime(F.col(declared), head, safe)))
    df = df.withColumns({
        "document_type": F.when(bad, V.DEFAULT_TYPE).otherwise(type_by_name(F.col("_lower"), keywords)),
        "file_extension": F.when(bad, ".unknown").otherwise(N.suffix(F.col("_lower"))),
        "is_supported": ~bad & F.col("mime_type").isin(V.SUPPORTED_MIME_TYPES),
    })
    return df.withColumns({
        "confidence": F.when(bad, F.lit(0.0)).otherwise(
            type_confidence(F.col("document_type"), F.col("mime_type"))),
        "metadata": F.struct(
            F.coalesce(F.when(~bad, safe), F.col(name), F.lit("unknown")).alias("file_name"),
            F.coalesce(F.col(size), F.lit(0)).alias("file_size"),
            F.col("file_extension"), F.col("mime_type").alias("detected_mime"),
            F.when(bad, "File validation failed").alias("error")),
    }).drop("_safe", "_lower")


def type_mix(df: DataFrame) -> DataFrame:
    return df.groupBy("document_type").agg(F.count(F.lit(1)).alias("n_documents"))
