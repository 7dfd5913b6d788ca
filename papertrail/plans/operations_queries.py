"""Registered queries over manifests, pages, lifecycle events and webhooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from papertrail import fixed_values as V
from papertrail.functions import names as N
from papertrail.operators import admission as A, assemble as B, classify as C, lifecycle as H, webhooks as I
from papertrail.plans.document_queries import validated
from papertrail.plans.fixtures import table, view
from papertrail.session import shared_dir
from papertrail.sources.readers import lookup
from papertrail.sources.sinks import read_records, write_records


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "manifest")


def _admitted_flags(spark, sf):
    return A.admit(manifest(spark, sf))


def ingest_manifest(spark, sf):
    df = A.build_manifest(manifest(spark, sf), content="text")
    return A.admitted(A.admit(df)).select(
        "document_id", "file_name", "file_size", F.coalesce("mime_type", F.lit("")).alias("mime_type"), "status")


def manifest_hash(spark, sf):
    df = A.build_manifest(manifest(spark, sf).withColumnRenamed("document_id", "row_id"), content="text")
    return df.select("row_id", "content_hash", "document_id")


def admission(spark, sf):
    return _admitted_flags(spark, sf).select("document_id", "status_code", "reject_reason")


def admission_summary(spark, sf):
    return A.reject_summary(_admitted_flags(spark, sf))


def filename_check(spark, sf):
    return manifest(spark, sf).select("document_id", N.check_name(F.col("original_filename")).alias("c")) \
        .select("document_id", "c.*")


def filename_safe_counts(spark, sf):
    safe = N.check_name(F.col("original_filename"))["ok"].alias("is_safe")
    return manifest(spark, sf).groupBy(safe).agg(F.count(F.lit(1)).alias("n_files"))


URL_PATH = r"^[a-z]+://[^/]*([^?#]*)"


def path_audit(spark, sf):
    pages = table(spark, sf, "pages")
    path = F.regexp_extract("url", URL_PATH, 1)
    variants = F.array(*[F.struct(F.lit(n).alias("variant"), parts.alias("parts")) for n, parts in (
        ("url", F.array("url")), ("path", F.array(path)), ("tail", F.array(F.lit("in"), F.substr(path, F.lit(2)))),
        ("deep", F.array_repeat(F.lit("a/b"), 5 + (F.col("page_id") % 2).cast("int"))))])
    return pages.select("page_id", F.inline(variants)).select(
        "page_id", "variant", N.path_parts(F.col("parts")).alias("p")).select("page_id", "variant", "p.verdict", "p.depth", "p.path")


def path_basename(spark, sf):
    path = F.regexp_extract("url", URL_PATH, 1)
    return table(spark, sf, "pages").select(
        "page_id", N.base_name_if_absolute(path).alias("base_name"), N.base_name_if_absolute(F.col("url")).alias("url_name"),
        N.forward_slashes(F.replace(path, F.lit("/"), F.lit("\\"))).alias("normalized"))


def storage_name(spark, sf):
    return manifest(spark, sf).select(
        "document_id", N.storage_name(F.col("original_filename"), F.col("document_id")).alias("storage_name"),
        N.storage_name(F.col("original_filename")).alias("plain_name"))


def security_events(spark, sf):
    return A.security_events(manifest(spark, sf)).groupBy("event_type", "level").agg(
        F.count(F.lit(1)).alias("n_events"), F.min("document_id").alias("first_document"),
        F.sum("file_size").alias("total_bytes"))


def content_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("content_hash"))
    return A.first_copies(docs, "content_hash", "doc_id").select("doc_id", "content_hash")


def duplicate_groups(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("content_hash"))
    return A.copy_groups(docs, "content_hash", "doc_id")


def mime_resolve(spark, sf):
    safe = N.check_name(F.col("original_filename"))["sanitized"]
    # Every fifth text stands for a PDF's first bytes, so that the signature branch runs too.
    head = F.when(F.col("document_id") % 5 == 0, F.concat(F.lit("%PDF-1.7"), F.col("text"))) \
        .otherwise(F.col("text")).cast("binary")
    return manifest(spark, sf).select(
        "document_id", A.resolve_mime(F.col("content_type"), head, safe).alias("mime_type"),
        A.resolve_mime(F.col("content_type"), None, safe).alias("mime_without_content"))


def _classified(df: DataFrame) -> DataFrame:
    return df.select("document_id", "document_type", F.round("confidence", 6).alias("confidence"), "mime_type",
                     "file_extension", "is_supported", F.col("metadata.file_size").alias("file_size"))


def classify(spark, sf):
    return _classified(C.classify(manifest(spark, sf).filter(N.check_name(F.col("original_filename"))["ok"])))


def _with_rejects(spark, sf):
    return C.classify(_admitted_flags(spark, sf), rejected=F.col("reject_reason").isNotNull())


def classify_with_rejects(spark, sf):
    return _classified(_with_rejects(spark, sf))


def type_mix(spark, sf):
    return C.type_mix(_with_rejects(spark, sf))


def ocr_gate(spark, sf):
    return _admitted_flags(spark, sf).withColumn("gate_reason", A.extraction_gate(F.col("file_size"))).select(
        "document_id", F.col("reject_reason").isNull().alias("admitted"), "gate_reason")


def pages(spark, sf):
    mime = F.when(F.col("document_id") % 3 == 0, "image/png").otherwise("application/pdf")
    return view(spark, sf, "text_pages").withColumn("mime_type", mime)


def page_stats(spark, sf):
    return B.page_stats(pages(spark, sf)).select("document_id", "page_number", "word_count", "has_images")


def page_assembly(spark, sf):
    return B.assemble_pages(pages(spark, sf)).select(
        "document_id", "total_pages", "processed_pages", "n_words", F.round("average_confidence", 6).alias("average_confidence"),
        F.md5("full_text").alias("text_md5"), F.length("full_text").alias("text_length"))


def _assembled(spark, sf):
    documents = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"))
    return B.with_empty_documents(documents, B.assemble_pages(pages(spark, sf)))


def page_segments(spark, sf):
    """Text by runs of three pages, page numbers from 0 on."""
    found = B.page_segments(pages(spark, sf).withColumn("page_number", F.col("page_number") - 1), 3)
    return found.select("document_id", "segment", "n_pages", "n_words", F.md5("text").alias("text_md5"))


def record_store(spark, sf):
    """Three batches of records written to one store, the second one twice; the last record of each document counts."""
    path = shared_dir(spark, "record-store")
    rows = manifest(spark, sf).select("document_id", F.when(F.col("document_id") % 2 == 0, "invoice").otherwise("form")
                                      .alias("document_type"), "file_size")
    for batch, kept in ((0, "document_id % 3 < 2"), (1, "document_id % 3 > 0"), (1, "document_id % 3 > 0"), (2, "document_id % 5 = 0")):
        write_records(rows.filter(kept).withColumn("version", F.lit(batch)), path, batch)
    return read_records(spark, path).select("document_id", "document_type", "file_size", "version")


def page_assembly_empty(spark, sf):
    return _assembled(spark, sf).select(
        "document_id", "total_pages", "processed_pages", F.md5("full_text").alias("text_md5"),
        F.round("average_confidence", 6).alias("average_confidence"))


def text_source_pick(spark, sf):
    return B.pick_source(pages(spark, sf)).select(
        "document_id", "source", "n_pages", F.round("average_confidence", 6).alias("average_confidence"))


def extract_text_batch(spark, sf):
    files = table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return B.extract_text(files, "doc_id").select("doc_id", F.md5("text").alias("text_md5"), "error")


def low_confidence_docs(spark, sf):
    return B.low_confidence(_assembled(spark, sf)).select(
        "document_id", F.round("average_confidence", 6).alias("average_confidence"))


# --- lifecycle ---------------------------------------------------------------------

def log(spark, sf):
    return view(spark, sf, "task_log")


def _with_error(spark, sf):
    return log(spark, sf).withColumn("error", F.when(
        F.col("task_status").isin("RETRY", "FAILURE"), F.concat(F.lit("attempt "), F.col("event_id").cast("string"))))


def lifecycle_state(spark, sf):
    flagged = _admitted_flags(spark, sf)
    df = H.stage_outcomes(flagged, {
        "classification": F.when(F.col("reject_reason").isNotNull(), F.concat(F.lit("rejected: "), F.col("reject_reason"))),
        "ocr": A.extraction_gate(F.col("file_size")),
        "analysis": F.when(F.coalesce(F.col("text"), F.lit("")) == "", "no text to analyze")})
    return df.select("document_id", "stage", "failed_stage", "error", "stages_run")


def stage_run_fold(spark, sf):
    runs = H.attempt_fold(_with_error(spark, sf), "error")
    return H.fold_stage_runs(runs, "job_id")


def attempt_fold(spark, sf):
    return H.attempt_fold(_with_error(spark, sf), "error").select(
        "job_id", "stage", "status", "retry_count", "error_count", "duration_ms", "error")


def status_map(spark, sf):
    return log(spark, sf).select("event_id", H.public_status(F.col("task_status")).alias("status"))


def current_state(spark, sf):
    return H.current_state(log(spark, sf)).select(
        "job_id", "event_id", "updated_at", "uploaded_at", "task_status", "stage", "status", "n_events")


def state_lookup(spark, sf):
    ids = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("job_id"))
    return lookup(H.current_state(log(spark, sf)), ids, "job_id").select("job_id", "event_id", "status")


def ttl_live_keys(spark, sf):
    events = log(spark, sf)
    return H.live_keys(events, H.latest_time(events))


def metrics(spark, sf):
    events = log(spark, sf)
    live = H.live_keys(events, H.latest_time(events)).filter("job_live")
    return H.metrics(H.current_state(events), _registry(spark, sf), live)


def stage_metrics(spark, sf):
    return H.stage_metrics(log(spark, sf)).select(
        "stage", "n_finished", F.round("average_time_ms", 6).alias("average_time_ms"),
        F.round("success_rate", 6).alias("success_rate"))


def stuck_tasks(spark, sf):
    events = log(spark, sf)
    return H.stuck_tasks(H.current_state(events), H.latest_time(events)).select(
        "job_id", "status", "task_status", "uploaded_at", "stuck_seconds")


def recovery_queue(spark, sf):
    events = log(spark, sf)
    suffix = F.when(F.col("job_id") % 2 == 0, ".pdf").otherwise(".png")
    return H.recovery_queue(H.current_state(events), H.latest_time(events), suffix=suffix)


def retry_rows(spark, sf):
    ids = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("job_id"))
    return H.retry_rows(H.current_state(log(spark, sf)), ids)


def failure_state(spark, sf):
    return H.failure_state(_with_error(spark, sf), "error")


def rate_limit_windows(spark, sf):
    return H.rate_windows(log(spark, sf), "job_id", "1 day", 5)


def rate_limit_admit(spark, sf):
    return H.rate_admission(log(spark, sf), "job_id", "1 day", 5).select("event_id", "admitted")


def stage_pivot(spark, sf):
    return H.stage_pivot(log(spark, sf))


def job_results(spark, sf):
    return H.job_results(log(spark, sf))


# --- webhooks ----------------------------------------------------------------------

def _registry(spark, sf):
    changes = view(spark, sf, "webhook_log").withColumn("events", F.split("events_csv", ","))
    return I.registry(changes)


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select("webhook_id", "url", "active", F.array_join("events", ",").alias("events_csv"), *more)


def webhook_registry(spark, sf):
    return _shown(_registry(spark, sf))


def webhooks_active(spark, sf):
    return _shown(I.active(_registry(spark, sf)))


def registry_merge(spark, sf):
    legacy = view(spark, sf, "webhook_log").withColumn("webhook_id", F.col("webhook_id") * 3) \
        .withColumn("events", F.split("events_csv", ","))
    return _shown(I.merge_registries(_registry(spark, sf), I.registry(legacy)), "store")


def _gated(spark, sf):
    return I.delivery_gate(validated(spark, sf))


def delivery_gate(spark, sf):
    return _gated(spark, sf).select("doc_id", "document_type", "event")


def subscription_match(spark, sf):
    event = F.when(F.col("is_valid"), V.PROCESSED_EVENT).otherwise("document.failed")
    events = validated(spark, sf).select("doc_id", event.alias("event"))
    matches = I.match_subscriptions(events, _registry(spark, sf))
    return matches.select("doc_id", "webhook_id", "delivery_status", "reason")


def subscription_skips(spark, sf):
    """Also for an event that nobody knows."""
    event = F.when(F.col("doc_id") % 10 == 0, "document.archived").when(F.col("is_valid"), V.PROCESSED_EVENT) \
        .otherwise("document.failed")
    return I.skipped_subscriptions(validated(spark, sf).select("doc_id", event.alias("event")), _registry(spark, sf))


def outbox(spark, sf):
    record = F.to_json(F.struct("document_type", F.col("is_valid").alias("valid")))
    events = _gated(spark, sf).select("doc_id", "event", record.alias("record"))
    events = I.with_payload(events, "doc_id", "record", F.lit("2024-01-01T00:00:00Z")).drop("record")
    sent = I.outbox(I.match_subscriptions(events, _registry(spark, sf)), "doc_id")
    leaf = lambda path: F.get_json_object("payload", f"$.{path}")
    return sent.select("delivery_id", "doc_id", "webhook_id", "url", leaf("event").alias("event"),
                       leaf("job_id").alias("job_id"), leaf("timestamp").alias("sent_at"),
                       leaf("schema.document_type").alias("document_type"), leaf("schema.valid").alias("valid"))


def _deliveries(spark, sf):
    return view(spark, sf, "deliveries").withColumn(
        "delivery_status", I.outcome(F.col("status_code"), F.col("transport_error")))


def delivery_outcome(spark, sf):
    return _deliveries(spark, sf).select("delivery_id", "webhook_id", "delivery_status")


def delivery_ledger(spark, sf):
    """Events as attempts, seven to a delivery at most; every eleventh delivery has none."""
    tried = _deliveries(spark, sf).withColumn("delivery_id", F.floor(F.col("delivery_id") / 7).cast("long")) \
        .withColumnRenamed("ts", "attempted_at")
    ids = tried.select("delivery_id").distinct()
    kept = tried.filter("delivery_id % 11 <> 0 AND (status_code IS NULL OR status_code >= 300 OR delivery_id % 3 = 0)")
    as_of = tried.agg(F.max("attempted_at").alias("t")).scalar()
    return I.delivery_ledger(ids, kept, as_of, max_retries=4, delay_seconds=3600, growth=4.0)


def delivery_rollup(spark, sf):
    return I.delivery_rollup(_deliveries(spark, sf), "webhook_id")


def delivery_details(spark, sf):
    return I.delivery_details(_deliveries(spark, sf), "webhook_id", part=F.shiftright("delivery_id", 16)).withColumn(
        "status_code", F.coalesce("status_code", F.lit(0)))


QUERIES = {f.__name__: f for f in (
    ingest_manifest, manifest_hash, admission, admission_summary, filename_check, filename_safe_counts, path_audit,
    path_basename, storage_name, security_events, content_dedup, duplicate_groups, mime_resolve, classify,
    classify_with_rejects, type_mix, ocr_gate, page_stats, page_assembly, page_assembly_empty, text_source_pick,
    extract_text_batch, low_confidence_docs, lifecycle_state, stage_run_fold, attempt_fold, status_map, current_state,
    state_lookup, ttl_live_keys, metrics, stage_metrics, stuck_tasks, recovery_queue, retry_rows, failure_state,
    rate_limit_windows, rate_limit_admit, stage_pivot, job_results, webhook_registry, webhooks_active, registry_merge,
    delivery_gate, subscription_match, subscription_skips, record_store, page_segments, outbox, delivery_outcome, delivery_ledger,
    delivery_rollup, delivery_details)}
