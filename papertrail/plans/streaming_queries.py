"""Registered streaming jobs: each runs to the end of its input and returns the result table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from papertrail.operators import webhooks as I
from papertrail.plans import fixtures
from papertrail.plans.operations_queries import _registry
from papertrail.session import shared_dir
from papertrail.sources.readers import event_time, stream_table
from papertrail.sources.sinks import read_first, read_outbox
from papertrail.sources.store import is_folder
from papertrail.streaming import jobs


def source(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = f"{sf}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    if is_folder(spark, path):
        return stream_table(spark, path, schema, "*")
    return stream_table(spark, sf, schema, f"{name}.parquet")  # a stream's path is a folder; the filter is on file names


def _view(spark: SparkSession, sf: str, name: str, base: str) -> DataFrame:
    return spark.sql(fixtures.bound_sql(name), **{base: source(spark, sf, base)})


def _log(spark, sf):
    return event_time(_view(spark, sf, "task_log", "events"))


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    out, state = shared_dir(spark, "ingest"), shared_dir(spark, "checkpoint")
    columns = ["document_id", "document_type", "fields_above_threshold", "is_valid", "total_checks"]
    few_splits = (spark.sparkContext.defaultParallelism, "document_id")
    jobs.finish(jobs.ingest(_view(spark, sf, "manifest", "documents"), out, state, columns, few_splits))
    return spark.read.parquet(out)


def stream_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """What ``stream_ingest`` has no row for."""
    out, state = shared_dir(spark, "quarantine"), shared_dir(spark, "checkpoint")
    jobs.finish(jobs.quarantine(_view(spark, sf, "manifest", "documents"), out, state))
    return spark.read.parquet(out)


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out, state = shared_dir(spark, "dedup"), shared_dir(spark, "checkpoint")
    uploads = source(spark, sf, "documents").select(
        "doc_id", F.md5("text").alias("content_hash"), F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id")).alias("uploaded_at"))
    jobs.finish(jobs.first_ever(uploads, out, state, keep=("doc_id",)))
    return read_first(spark, out).select("content_hash", "doc_id")


def stream_state(spark: SparkSession, sf: str) -> DataFrame:
    out, state = shared_dir(spark, "state"), shared_dir(spark, "checkpoint")
    jobs.finish(jobs.track_state(_log(spark, sf), out, state))
    return jobs.read_state(spark, out).select(
        "job_id", F.col("last.event_id").alias("event_id"), F.col("last.task_status").alias("task_status"),
        F.col("last.stage").alias("stage"), "n_events")


def stream_stuck(spark: SparkSession, sf: str) -> DataFrame:
    out, state = shared_dir(spark, "stuck"), shared_dir(spark, "checkpoint")
    jobs.finish(jobs.stuck(_log(spark, sf), out, state))
    return spark.read.parquet(out).select("job_id", "event_id")


def stream_rate(spark: SparkSession, sf: str) -> DataFrame:
    out, state = shared_dir(spark, "rate"), shared_dir(spark, "checkpoint")
    jobs.finish(jobs.rate_windows(_log(spark, sf), out, state, "job_id", "1 day", 5))
    return spark.read.parquet(out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_admit(spark: SparkSession, sf: str) -> DataFrame:
    out, state = shared_dir(spark, "admit"), shared_dir(spark, "checkpoint")
    jobs.finish(jobs.admit_requests(_log(spark, sf).select("event_id", "job_id", "ts"), out, state, "job_id", "1 day", 5))
    return spark.read.parquet(out).select("event_id", "job_id", "admitted")


def stream_outbox(spark: SparkSession, sf: str) -> DataFrame:
    out, state = shared_dir(spark, "outbox"), shared_dir(spark, "checkpoint")
    checked = jobs.document_flow(_view(spark, sf, "manifest", "documents"))
    jobs.finish(jobs.deliver(I.delivery_gate(checked).select("document_id", "event"), _registry(spark, sf), out, state))
    return read_outbox(spark, out).select("delivery_id", "document_id", "webhook_id")


QUERIES = {f.__name__: f for f in (
    stream_ingest, stream_quarantine, stream_dedup, stream_state, stream_stuck, stream_rate, stream_admit,
    stream_outbox)}
