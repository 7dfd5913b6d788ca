"""Upload admission: manifest, reject reasons, security events, duplicates, MIME types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from papertrail import fixed_values as V
from papertrail.functions import names as N
from papertrail.functions.fence import fence


def build_manifest(df: DataFrame, content: str = "content", name: str = "original_filename",
                   mime: str = "content_type") -> DataFrame:
    """Adds content_hash, derived document_id / job_id, file_name, mime_type and status.

    Ids are hashes of content and name, so a rerun gives the same ids.
    """
    document_id = F.sha2(F.concat_ws("|", "content_hash", F.col(name)), 256)
    out = df.withColumn("content_hash", F.sha2(F.col(content).cast("binary"), 256)) \
        .withColumn("file_name", N.check_name(F.col(name))["sanitized"])
    if "document_id" not in df.columns:
        out = out.withColumn("document_id", document_id)
    return out.withColumns({
        "job_id": F.sha2(F.concat_ws("|", F.lit("job"), F.col("content_hash"), F.col(name)), 256),
        "mime_type": F.col(mime) if mime in df.columns else F.lit(None).cast("string"),
        "status": F.lit("processing")})


def admit(df: DataFrame, name: str = "original_filename", size: str = "file_size",
          max_bytes: int = V.MAX_UPLOAD_BYTES, extensions: list[str] | None = None) -> DataFrame:
    """Adds reject_reason (the first failing check, NULL when admitted) and status_code
    (202 admitted, 400, or 413 for size)."""
    given = F.col(name)
    ending = F.lower(N.suffix(F.replace(given, F.lit("/"), F.lit("_"))))
    reason = F.when(given.isNull() | (given == ""), "name_missing") \
        .when(F.col("_class") != N.OK, "unsafe_name") \
        .when(~ending.isin(extensions or V.ALLOWED_EXTENSIONS), "extension_not_allowed") \
        .when(F.col(size) > max_bytes, "too_large") \
        .when(F.col(size) == 0, "empty_file")
    judged = df.withColumn("_class", N.name_class(given)).withColumn("reject_reason", reason)
    return fence(judged.drop("_class"), "reject_reason").withColumn(
        "status_code", F.when(F.col("reject_reason").isNull(), 202)
        .when(F.col("reject_reason") == "too_large", 413).otherwise(400))


def admitted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reject_reason").isNull())


def quarantined(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reject_reason").isNotNull())


def reject_summary(df: DataFrame, size: str = "file_size") -> DataFrame:
    return df.groupBy("status_code", F.coalesce("reject_reason", F.lit("admitted")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(size).alias("total_bytes"))


def security_events(df: DataFrame, name: str = "original_filename",
                    event_type: str = "DANGEROUS_FILENAME_ATTEMPT", level: str = "ERROR") -> DataFrame:
    """One event per traversal attempt; plain invalid names are rejected without an event."""
    return df.filter(N.name_class(F.col(name)) == N.TRAVERSAL) \
        .withColumns({"event_type": F.lit(event_type), "level": F.lit(level)})


def first_copies(df: DataFrame, hash_col: str = "content_hash", id_col: str = "document_id") -> DataFrame:
    """One row per content hash: the smallest id.  Rows without a hash are no copies of each other and stay.

    Copies are counted down on the map side (``min`` per hash), then rows are kept by their unique id,
    so a hash shared by a third of all rows is no hot key anywhere.
    """
    alone = F.when(F.col(hash_col).isNull(), F.col(id_col))
    keepers = df.groupBy(hash_col, alone.alias("_alone")).agg(F.min(id_col).alias(id_col)).select(id_col)
    return df.join(keepers, id_col, "left_semi")


def copy_groups(df: DataFrame, hash_col: str = "content_hash", id_col: str = "document_id") -> DataFrame:
    return df.filter(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(
        F.count(F.lit(1)).alias("n_copies"), F.min(id_col).alias("first_id")) \
        .filter(F.col("n_copies") > 1)


def resolve_mime(declared: Column, head: Column | None, name: Column,
                 extension_mime: dict[str, str] | None = None) -> Column:
    """Declared type, else by content signature, else by extension, else the default type.

    ``head``: the content's first bytes as BINARY.
    """
    by_name = F.lit(None).cast("string")
    ending = F.lower(N.suffix(name))
    for extension, mime in (extension_mime or V.EXTENSION_MIME).items():
        by_name = F.when(ending == extension, mime).otherwise(by_name)
    sniffed = F.lit(None).cast("string")
    if head is not None:
        prefix = F.hex(F.substring(head, 1, 8))
        for signature, mime in V.SIGNATURE_MIME.items():
            sniffed = F.when(F.startswith(prefix, F.lit(signature)), mime).otherwise(sniffed)
    return F.coalesce(F.when(declared != "", declared), sniffed, by_name, F.lit(V.DEFAULT_MIME))


def extraction_gate(size: Column, max_bytes: int = V.MAX_EXTRACT_BYTES) -> Column:
    """Why a file is not sent to text extraction, NULL when it is."""
    return F.when(size > max_bytes, "too_large_to_extract")
