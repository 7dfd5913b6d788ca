"""All registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from papertrail.plans import (
    document_oracles, document_queries, operations_oracles, operations_queries, streaming_oracles,
    streaming_queries)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    checked = document_queries.validated(spark, sf)
    return checked.filter(F.col("document_type") == "invoice").select(
        "doc_id", "is_valid", F.round("validation_score", 6).alias("validation_score"),
        "total_checks", "failed_checks", F.array_join("errors", " | ").alias("errors"),
        F.array_join("warnings", " | ").alias("warnings"))


# Columns that are 32-bit in Spark (positions and array sizes), by query.
_INTEGERS = {
    **{q: ["n_hits"] for q in document_queries.QUERIES if q.startswith("pat_")},
    **{q: ["pos"] for q in document_queries.QUERIES if q.startswith(("extract_", "nda_"))
       and q not in ("extract_tables", "nda_override")},
    **{q: ["pos"] for q in ("fields_long", "checks", "format_validators")},
    **{q: ["total_checks", "passed_checks", "failed_checks"] for q in ("verdict_strict", "verdict_lenient")},
    "path_audit": ["depth"], "page_stats": ["word_count"], "page_assembly": ["text_length"],
    "extract_tables": ["row_count"], "record_tables": ["row_count"], "table_rows": ["row_no"],
    "analysis_summary": ["total_fields_extracted", "fields_above_threshold"],
    "record_invoice": ["n_items"], "record_receipt": ["n_items"], "record_metadata": ["field_count"],
    "schema_json": ["field_count"], "flat_data": ["ord"],
    "stream_ingest": ["fields_above_threshold", "total_checks"],
}


def queries() -> dict:
    return {**operations_queries.QUERIES, **document_queries.QUERIES, **streaming_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    sql = {**operations_oracles.oracles(), **document_oracles.oracles(), **streaming_oracles.oracles()}
    for name, columns in _INTEGERS.items():
        casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in columns)
        sql[name] = f"SELECT * REPLACE ({casts}) FROM ({sql[name]}) typed"
    return sql
