"""DuckDB SQL for the manifest, page, lifecycle and webhook queries."""

from __future__ import annotations

from papertrail import fixed_values as V
from papertrail.operators.validate import rule_rows
from papertrail.plans.document_oracles import checks_cte, flow, q
from papertrail.plans.fixtures import DELIVERIES, MANIFEST, TASK_LOG, TEXT_PAGES, WEBHOOK_LOG


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


NAME = "original_filename"
UNSAFE = " OR ".join(f"contains({NAME}, {p})" for p in ("'..'", "'~'", "'//'", "chr(0)", "chr(13)", "chr(10)", "chr(92)"))
CLASS = (rf"CASE WHEN {NAME} IS NULL OR {NAME} = '' OR regexp_full_match({NAME}, '\s+') THEN 'value_error' WHEN length({NAME}) > 4096 THEN 'traversal' "
         rf"WHEN {UNSAFE} THEN 'traversal' WHEN regexp_matches({NAME}, '[\x00-\x08\x0a-\x1f]') THEN 'traversal' ELSE 'ok' END")
SUFFIX = r"regexp_extract(safe_name, '^(?:.|\n)+(\.[^.]+)$', 1)"
M = f"""WITH m0 AS MATERIALIZED ({MANIFEST}),
m1 AS (SELECT *, {CLASS} AS cls FROM m0),
m2 AS (SELECT *, CASE WHEN cls = 'ok' THEN replace({NAME}, '/', '_') END AS safe_name FROM m1),
m3 AS (SELECT *, {SUFFIX} AS suffix FROM m2),
m AS MATERIALIZED (SELECT *, CASE WHEN {NAME} IS NULL OR {NAME} = '' THEN 'name_missing' WHEN cls <> 'ok' THEN 'unsafe_name'
 WHEN lower(suffix) NOT IN {in_list(V.ALLOWED_EXTENSIONS)} THEN 'extension_not_allowed' WHEN file_size > {V.MAX_UPLOAD_BYTES} THEN 'too_large'
 WHEN file_size = 0 THEN 'empty_file' END AS reject_reason FROM m3)
"""
CODE = "CASE WHEN reject_reason IS NULL THEN 202 WHEN reject_reason = 'too_large' THEN 413 ELSE 400 END"
BY_EXT = "CASE lower(suffix) " + " ".join(f"WHEN '{e}' THEN '{t}'" for e, t in V.EXTENSION_MIME.items()) + " END"


def mime(head: str | None) -> str:
    sniff = "" if head is None else f"CASE WHEN starts_with({head}, '%PDF') THEN 'application/pdf' WHEN starts_with({head}, 'BM') THEN 'image/bmp' END, "
    return f"coalesce(nullif(content_type, ''), {sniff}{BY_EXT}, '{V.DEFAULT_MIME}')"


def name_type(name: str) -> str:
    tests = " ".join("WHEN " + " OR ".join(f"contains({name}, {q(w)})" for w in words) + f" THEN '{kind}'" for kind, words in V.NAME_KEYWORDS)
    return f"CASE {tests} ELSE 'document' END"


def classified(bad: str) -> str:
    return f"""c0 AS (SELECT document_id, {bad} AS bad, CASE WHEN {bad} THEN 'application/octet-stream' ELSE {mime(None)} END AS mime_type,
 CASE WHEN {bad} THEN 'document' ELSE {name_type('lower(safe_name)')} END AS document_type,
 CASE WHEN {bad} THEN '.unknown' ELSE lower(suffix) END AS file_extension, file_size FROM m),
c AS (SELECT document_id, document_type, CASE WHEN bad THEN 0.0 ELSE round(least(0.5 + CASE WHEN mime_type IN {in_list(V.SUPPORTED_MIME_TYPES)} THEN 0.2 ELSE 0 END
 + CASE WHEN document_type <> 'document' THEN 0.2 ELSE 0 END + CASE WHEN mime_type = 'application/pdf' THEN 0.1 ELSE 0 END, 1.0), 6) END::DOUBLE AS confidence, mime_type,
 file_extension, NOT bad AND mime_type IN {in_list(V.SUPPORTED_MIME_TYPES)} AS is_supported, file_size FROM c0)"""


PAGES = f"""p0 AS ({TEXT_PAGES}),
p AS (SELECT *, CASE WHEN document_id % 3 = 0 THEN 'image/png' ELSE 'application/pdf' END AS mime_type,
 len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS word_count FROM p0),
a AS (SELECT document_id, count(*) AS total_pages, count(*) AS processed_pages, sum(word_count)::BIGINT AS n_words, avg(confidence) AS average_confidence,
 string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS full_text FROM p WHERE text <> '' GROUP BY document_id),
e AS (SELECT d.doc_id AS document_id, coalesce(total_pages, 1) AS total_pages, coalesce(processed_pages, 0) AS processed_pages, coalesce(full_text, '') AS full_text,
 coalesce(average_confidence, 0.0) AS average_confidence FROM documents d LEFT JOIN a ON a.document_id = d.doc_id)"""

L = f"""WITH l AS (SELECT *, CASE WHEN task_status IN ('RETRY', 'FAILURE') THEN 'attempt ' || event_id END AS error FROM ({TASK_LOG}) x),
now AS (SELECT max(ts) + INTERVAL 1 MINUTE AS as_of FROM l),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS rn, min(ts) OVER (PARTITION BY job_id) AS uploaded_at,
 count(*) OVER (PARTITION BY job_id) AS n_events, CASE task_status WHEN 'SUCCESS' THEN 'completed' WHEN 'FAILURE' THEN 'failed' ELSE 'processing' END AS status FROM l) z WHERE rn = 1)
"""
LIMIT = "CASE stage " + " ".join(f"WHEN '{s}' THEN {n}" for s, n in V.STAGE_ATTEMPTS.items()) + " END"
FOLD = f""", g AS (SELECT job_id, stage, count(*) FILTER (task_status = 'SUCCESS') AS s, count(*) FILTER (task_status = 'FAILURE') AS f,
 count(*) FILTER (task_status = 'STARTED') AS st, count(*) FILTER (task_status = 'RETRY') AS retry_count, count(*) FILTER (task_status IN ('RETRY', 'FAILURE')) AS error_count,
 date_sub('millisecond', min(ts), max(ts)) AS duration_ms, arg_max(error, (ts, event_id)) FILTER (error IS NOT NULL) AS error FROM l GROUP BY job_id, stage),
runs AS (SELECT job_id, stage, CASE WHEN s > 0 THEN 'completed' WHEN f > 0 OR error_count >= {LIMIT} THEN 'failed' WHEN error_count > 0 THEN 'retrying'
 WHEN st > 0 THEN 'running' ELSE 'pending' END AS status, retry_count, error_count, duration_ms, error FROM g) """


def registry_sql(log: str, name: str) -> str:
    """The fold, step by step with windows: rows since the last register of ids not deleted after it."""
    return f"""{name}_log AS ({log}),
{name}_edge AS (SELECT webhook_id, max(seq) FILTER (op = 'register') AS r, coalesce(max(seq) FILTER (op = 'delete'), -1) AS d FROM {name}_log GROUP BY webhook_id),
{name}_live AS (SELECT l.* FROM {name}_log l JOIN {name}_edge e USING (webhook_id) WHERE e.r > e.d AND l.seq >= e.r AND l.op <> 'delete'),
{name} AS (SELECT DISTINCT webhook_id, last_value(url IGNORE NULLS) OVER w AS url, coalesce(last_value(active IGNORE NULLS) OVER w, true) AS active,
 coalesce(last_value(events_csv IGNORE NULLS) OVER w, 'document.processed') AS events_csv FROM {name}_live
 WINDOW w AS (PARTITION BY webhook_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


REG = registry_sql(WEBHOOK_LOG, "reg")
V_ = (f"WITH v AS (SELECT *, CASE WHEN transport_error = 'timeout' THEN 'timeout' WHEN transport_error IS NOT NULL THEN 'error' WHEN status_code BETWEEN 200 AND 299 "
      f"THEN 'success' ELSE 'failed' END AS delivery_status FROM ({DELIVERIES}) x) ")
URL_PATH = "regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1)"


def oracles() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["ingest_manifest"] = M + ("SELECT document_id, safe_name AS file_name, file_size, coalesce(content_type, '') AS mime_type, 'processing' AS status FROM m "
                                  "WHERE reject_reason IS NULL")
    sql["manifest_hash"] = M + (f"SELECT document_id AS row_id, sha256(text) AS content_hash, sha256(concat_ws('|', sha256(text), {NAME})) AS document_id FROM m")
    sql["admission"] = M + f"SELECT document_id, {CODE} AS status_code, reject_reason FROM m"
    sql["admission_summary"] = M + (f"SELECT {CODE} AS status_code, coalesce(reject_reason, 'admitted') AS reason, count(*) AS n_files, sum(file_size)::BIGINT AS total_bytes "
                                    "FROM m GROUP BY ALL")
    sql["filename_check"] = M + "SELECT document_id, cls = 'ok' AS ok, nullif(cls, 'ok') AS error_class, safe_name AS sanitized FROM m"
    sql["filename_safe_counts"] = M + "SELECT cls = 'ok' AS is_safe, count(*) AS n_files FROM m GROUP BY 1"
    bad_text = " OR ".join(f"contains(c, {p})" for p in ("'..'", "'~'", "'//'", "chr(0)", "chr(13)", "chr(10)", "chr(92)"))
    sql["path_audit"] = f"""WITH u AS (SELECT page_id, url, {URL_PATH} AS path FROM pages),
parts AS (SELECT page_id, 'url' AS variant, 1 AS i, url AS c FROM u UNION ALL SELECT page_id, 'path', 1, path FROM u UNION ALL SELECT page_id, 'tail', 1, 'in' FROM u
 UNION ALL SELECT page_id, 'tail', 2, substring(path, 2) FROM u UNION ALL SELECT page_id, 'deep', n, 'a/b' FROM u, range(1, 7) r(n) WHERE n <= 5 + page_id % 2),
given AS (SELECT *, ({bad_text} OR length(c) > 4096) AS bad FROM parts WHERE c <> ''),
pieces AS (SELECT page_id, variant, i, unnest(string_split(c, '/')) AS piece, generate_subscripts(string_split(c, '/'), 1) AS j FROM given),
flags AS (SELECT page_id, variant, bool_or(piece IN ('..', '.', '~', '')) AS bad_piece, count(*) FILTER (trim(piece) <> '') AS depth,
 string_agg(trim(piece), '/' ORDER BY i, j) FILTER (trim(piece) <> '') AS path FROM pieces GROUP BY ALL),
bads AS (SELECT page_id, variant, bool_or(bad) AS bad FROM given GROUP BY ALL),
verdicts AS (SELECT f.*, CASE WHEN b.bad THEN 'dangerous_pattern' WHEN bad_piece THEN 'dangerous_component' WHEN depth > 10 THEN 'too_deep' ELSE 'ok' END AS verdict
 FROM flags f JOIN bads b USING (page_id, variant))
SELECT page_id, variant, verdict, depth, CASE WHEN verdict = 'ok' THEN path END AS path FROM verdicts"""
    base = "CASE WHEN starts_with({0}, '/') THEN coalesce(list_filter(string_split({0}, '/'), lambda x: x <> '')[-1], '') ELSE {0} END"
    sql["path_basename"] = f"WITH u AS (SELECT page_id, url, {URL_PATH} AS path FROM pages) SELECT page_id, {base.format('path')} AS base_name, {base.format('url')} AS url_name, path AS normalized FROM u"
    sql["storage_name"] = M + "SELECT document_id, CASE WHEN safe_name IS NOT NULL THEN document_id || suffix END AS storage_name, safe_name AS plain_name FROM m"
    sql["security_events"] = M + ("SELECT 'DANGEROUS_FILENAME_ATTEMPT' AS event_type, 'ERROR' AS level, count(*) AS n_events, min(document_id) AS first_document, "
                                  "sum(file_size)::BIGINT AS total_bytes FROM m WHERE cls = 'traversal'")
    sql["content_dedup"] = "SELECT min(doc_id) AS doc_id, md5(text) AS content_hash FROM documents GROUP BY md5(text)"
    sql["duplicate_groups"] = "SELECT md5(text) AS content_hash, count(*) AS n_copies, min(doc_id) AS first_id FROM documents GROUP BY md5(text) HAVING count(*) > 1"
    sql["mime_resolve"] = M + (f"SELECT document_id, {mime(chr(40) + 'CASE WHEN document_id % 5 = 0 THEN ' + q('%PDF-1.7') + ' || text ELSE text END' + chr(41))} AS mime_type, "
                               f"{mime(None)} AS mime_without_content FROM m")
    cols = "document_id, document_type, confidence, mime_type, file_extension, is_supported, file_size"
    sql["classify"] = M + ", " + classified("cls <> 'ok'") + f" SELECT {cols} FROM c JOIN (SELECT document_id FROM m WHERE cls = 'ok') k USING (document_id)"
    sql["classify_with_rejects"] = M + ", " + classified("reject_reason IS NOT NULL") + f" SELECT {cols} FROM c"
    sql["type_mix"] = M + ", " + classified("reject_reason IS NOT NULL") + " SELECT document_type, count(*) AS n_documents FROM c GROUP BY document_type"
    gate = f"CASE WHEN file_size > {V.MAX_EXTRACT_BYTES} THEN 'too_large_to_extract' END"
    sql["ocr_gate"] = M + f"SELECT document_id, reject_reason IS NULL AS admitted, {gate} AS gate_reason FROM m"
    sql["page_stats"] = f"WITH {PAGES} SELECT document_id, page_number, word_count, starts_with(mime_type, 'image/') AS has_images FROM p WHERE text <> ''"
    sql["page_assembly"] = (f"WITH {PAGES} SELECT document_id, total_pages, processed_pages, n_words, round(average_confidence, 6) AS average_confidence, md5(full_text) AS text_md5, "
                            "length(full_text) AS text_length FROM a")
    sql["page_assembly_empty"] = f"WITH {PAGES} SELECT document_id, total_pages, processed_pages, md5(full_text) AS text_md5, round(average_confidence, 6) AS average_confidence FROM e"
    sql["text_source_pick"] = f"""WITH {PAGES}, k AS (SELECT document_id, CASE WHEN bool_or(method = 'primary' AND text <> '') THEN 'primary' WHEN
 bool_or(method = 'fallback' AND text <> '') AND any_value(mime_type) = 'application/pdf' THEN 'fallback' ELSE 'empty' END AS source FROM p GROUP BY document_id)
SELECT k.document_id, source, count(p.text) AS n_pages, round(coalesce(avg(confidence), 0.0), 6) AS average_confidence FROM k LEFT JOIN p ON p.document_id = k.document_id
 AND p.method = k.source AND p.text <> '' GROUP BY k.document_id, source"""
    sql["extract_text_batch"] = "SELECT doc_id, md5(text) AS text_md5, NULL::VARCHAR AS error FROM documents"
    sql["low_confidence_docs"] = f"WITH {PAGES} SELECT document_id, round(average_confidence, 6) AS average_confidence FROM e WHERE average_confidence < 0.7"
    sql["lifecycle_state"] = M + f""", s AS (SELECT document_id, CASE WHEN reject_reason IS NOT NULL THEN 'classification' WHEN {gate} IS NOT NULL THEN 'ocr'
 WHEN coalesce(text, '') = '' THEN 'analysis' END AS failed_stage, reject_reason FROM m) SELECT document_id, CASE WHEN failed_stage IS NULL THEN 'completed' ELSE 'failed' END AS stage, failed_stage,
 CASE failed_stage WHEN 'classification' THEN 'Classification failed: rejected: ' || reject_reason WHEN 'ocr' THEN 'OCR failed: too_large_to_extract' WHEN 'analysis' THEN
 'Analysis failed: no text to analyze' END AS error, CASE failed_stage WHEN 'classification' THEN 1 WHEN 'ocr' THEN 2 WHEN 'analysis' THEN 3 ELSE 5 END AS stages_run FROM s"""
    order = "list_position(" + "[" + ", ".join(q(s) for s in V.STAGES) + "], stage)"
    label = "CASE stage " + " ".join(f"WHEN '{s}' THEN {q(t)}" for s, t in V.STAGE_LABELS.items()) + " END"
    sql["stage_run_fold"] = L + FOLD + f""", jobs AS (SELECT DISTINCT job_id FROM l),
names AS (SELECT unnest({[*V.STAGES]}) AS name, unnest(range(1, {len(V.STAGES) + 1})) AS place),
failed AS (SELECT job_id, arg_min(stage, place) AS stage, arg_min(error, place) AS error FROM runs JOIN names ON name = stage WHERE status = 'failed' GROUP BY job_id),
unfinished AS (SELECT job_id, arg_min(name, place) AS name FROM (SELECT job_id, name, place FROM jobs, names EXCEPT
 SELECT job_id, name, place FROM runs JOIN names ON name = stage WHERE status = 'completed') x GROUP BY job_id)
SELECT j.job_id, CASE WHEN f.job_id IS NOT NULL THEN 'failed' WHEN u.job_id IS NOT NULL THEN u.name ELSE 'completed' END AS stage, f.stage AS failed_stage,
 {label.replace('CASE stage', 'CASE f.stage')} || ' failed: ' || f.error AS error FROM jobs j LEFT JOIN failed f USING (job_id) LEFT JOIN unfinished u USING (job_id)"""
    sql["attempt_fold"] = L + FOLD + "SELECT * FROM runs"
    sql["status_map"] = L + "SELECT event_id, CASE task_status WHEN 'SUCCESS' THEN 'completed' WHEN 'FAILURE' THEN 'failed' ELSE 'processing' END AS status FROM l"
    sql["current_state"] = L + "SELECT job_id, event_id, ts AS updated_at, uploaded_at, task_status, stage, status, n_events FROM last"
    sql["state_lookup"] = L + "SELECT job_id, event_id, status FROM last WHERE job_id IN (SELECT s_suppkey FROM supplier)"
    ttl = L + (", k AS (SELECT job_id, max(ts) AS last_write FROM l GROUP BY job_id), t AS (SELECT job_id, last_write, last_write > as_of - INTERVAL 86400 SECOND AS document_live, "
               "last_write > as_of - INTERVAL 3600 SECOND AS job_live FROM k, now) ")
    sql["ttl_live_keys"] = ttl + "SELECT * FROM t"
    sql["metrics"] = ttl + f", {REG} " + ("SELECT count(*) AS total_documents, count(*) FILTER (status = 'completed') AS completed_documents, count(*) FILTER (status = 'failed') AS "
                                          "failed_documents, count(*) FILTER (status = 'processing') AS processing_documents, (SELECT count(*) FROM reg) AS registered_webhooks, "
                                          "(SELECT count(*) FROM t WHERE job_live) AS active_jobs FROM last")
    sql["stage_metrics"] = L + ("SELECT stage, count(*) AS n_finished, round(avg(duration_ms), 6) AS average_time_ms, round(avg(CASE WHEN task_status = 'SUCCESS' THEN 1.0 ELSE 0.0 END), 6) "
                                "AS success_rate FROM l WHERE task_status IN ('SUCCESS', 'FAILURE') GROUP BY stage")
    sql["stuck_tasks"] = L + ("SELECT job_id, status, task_status, uploaded_at, date_sub('second', uploaded_at, as_of) AS stuck_seconds FROM last, now WHERE task_status = 'PENDING'")
    requeue = "job_id, event_id AS old_task_id, sha256(concat_ws('|', CAST(job_id AS VARCHAR), CAST(event_id AS VARCHAR), '{0}')) AS new_task_id, 'processing' AS status, true AS {0}"
    sql["recovery_queue"] = L + (f"SELECT {requeue.format('auto_recovered')}, job_id || CASE WHEN job_id % 2 = 0 THEN '.pdf' ELSE '.png' END AS file_path FROM last, now "
                                 "WHERE task_status = 'PENDING' AND uploaded_at < as_of - INTERVAL 5 MINUTE")
    sql["retry_rows"] = L + f"SELECT {requeue.format('manual_retry')} FROM last WHERE job_id IN (SELECT n_nationkey FROM nation)"
    sql["failure_state"] = L + (", b AS (SELECT job_id, count(*) AS n_failures, max(ts) AS failed_at, arg_max(error, (ts, event_id)) AS error FROM l WHERE task_status = 'FAILURE' GROUP BY job_id) "
                                "SELECT last.job_id, last.status, coalesce(b.n_failures, 0) AS n_failures, b.failed_at, b.error FROM last LEFT JOIN b USING (job_id)")
    sql["rate_limit_windows"] = L + "SELECT job_id, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS n_requests, count(*) > 5 AS exceeded FROM l GROUP BY ALL"
    sql["rate_limit_admit"] = L + "SELECT event_id, row_number() OVER (PARTITION BY job_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 5 AS admitted FROM l"
    pivot = ", ".join(f"nullif(arg_max(task_status, (ts, event_id)) FILTER (stage = '{s}'), 'FAILURE') AS {s}" for s in V.STAGES)
    sql["stage_pivot"] = L + f"SELECT job_id, {pivot} FROM l GROUP BY job_id"
    sql["job_results"] = L + ("SELECT job_id, status, ts AS updated_at, CASE WHEN status = 'completed' THEN 'completed' END AS job_state FROM last WHERE status <> 'processing'")
    sql["webhook_registry"] = f"WITH {REG} SELECT * FROM reg"
    sql["webhooks_active"] = f"WITH {REG} SELECT * FROM reg WHERE active"
    legacy = registry_sql(f"SELECT webhook_id * 3 AS webhook_id, seq, op, url, active, events_csv FROM ({WEBHOOK_LOG}) x", "old")
    sql["registry_merge"] = (f"WITH {REG}, {legacy} SELECT coalesce(r.webhook_id, o.webhook_id) AS webhook_id, CASE WHEN r.webhook_id IS NULL THEN o.url ELSE r.url END AS url, "
                             "CASE WHEN r.webhook_id IS NULL THEN o.active ELSE r.active END AS active, CASE WHEN r.webhook_id IS NULL THEN o.events_csv ELSE r.events_csv END AS events_csv, "
                             "CASE WHEN r.webhook_id IS NULL THEN 'legacy' ELSE 'primary' END AS store FROM reg r FULL JOIN old o ON r.webhook_id = o.webhook_id")
    gate_sql = (f"WITH {flow()}, {checks_cte(rule_rows())}, {REG}, gated AS (SELECT doc_id, document_type FROM checks GROUP BY doc_id, document_type "
                "HAVING count(*) FILTER (NOT passed AND severity = 'error') = 0) ")
    sql["delivery_gate"] = gate_sql + "SELECT doc_id, document_type, 'document.processed' AS event FROM gated"
    match = ", hits AS (SELECT doc_id, document_type, webhook_id, url, list_contains(string_split(events_csv, ','), 'document.processed') AS ok FROM gated, reg WHERE active) "
    all_events = (", named AS (SELECT doc_id, CASE WHEN count(*) FILTER (NOT passed AND severity = 'error') = 0 THEN 'document.processed' ELSE 'document.failed' END AS event "
                  "FROM checks GROUP BY doc_id), hits AS (SELECT doc_id, webhook_id, list_contains(string_split(events_csv, ','), event) AS ok FROM named, reg WHERE active) ")
    sql["subscription_match"] = gate_sql + all_events + "SELECT doc_id, webhook_id, 'eligible' AS delivery_status, NULL::VARCHAR AS reason FROM hits WHERE ok"
    sql["subscription_skips"] = gate_sql + all_events + (
        ", occurred AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'document.archived' ELSE event END AS event, count(*) AS n_events FROM named GROUP BY 1) SELECT event, webhook_id, n_events, "
        "'skipped' AS delivery_status, 'event_not_subscribed' AS reason FROM occurred, reg WHERE active AND NOT list_contains(string_split(events_csv, ','), event)")
    sql["page_segments"] = f"WITH {PAGES} SELECT document_id, (page_number - 1) // 3 AS segment, count(*) AS n_pages, sum(word_count)::BIGINT AS n_words, " \
        "md5(string_agg(text, chr(10) || chr(10) ORDER BY page_number)) AS text_md5 FROM p WHERE text <> '' GROUP BY 1, 2"
    sql["record_store"] = M + ("SELECT document_id, CASE WHEN document_id % 2 = 0 THEN 'invoice' ELSE 'form' END AS document_type, file_size, "
                               "CASE WHEN document_id % 5 = 0 THEN 2 WHEN document_id % 3 > 0 THEN 1 ELSE 0 END::INTEGER AS version FROM m")
    sql["outbox"] = gate_sql + match + ("SELECT sha256(concat_ws('|', CAST(doc_id AS VARCHAR), CAST(webhook_id AS VARCHAR), 'document.processed')) AS delivery_id, doc_id, webhook_id, url, "
                                        "'document.processed' AS event, sha256('job|' || doc_id) AS job_id, '2024-01-01T00:00:00Z' AS sent_at, document_type, 'true' AS valid FROM hits WHERE ok")
    sql["delivery_outcome"] = V_ + "SELECT delivery_id, webhook_id, delivery_status FROM v"
    sql["delivery_ledger"] = V_ + (
        ", t AS (SELECT delivery_id // 7 AS d, ts, status_code, delivery_status AS s FROM v), "
        "k AS (SELECT * FROM t WHERE d % 11 <> 0 AND (status_code IS NULL OR status_code >= 300 OR d % 3 = 0)), "
        "g AS (SELECT d, count(*) AS n, bool_or(s = 'success') AS ok, max(ts) AS last_at, arg_max(s, (ts, s = 'success', s)) AS last_status FROM k GROUP BY d), "
        "w AS (SELECT *, CASE WHEN NOT ok AND n <= 4 THEN last_at + to_seconds(3600 * power(4, n - 1)) END AS again FROM g) "
        "SELECT i.d AS delivery_id, coalesce(n, 0) AS n_attempts, last_status, again AS next_attempt_at, CASE WHEN n IS NULL THEN 'new' WHEN ok THEN 'delivered' "
        "WHEN again IS NULL THEN 'exhausted' WHEN again > (SELECT max(ts) FROM t) THEN 'waiting' ELSE 'due' END AS ledger FROM (SELECT DISTINCT d FROM t) i LEFT JOIN w USING (d)")
    sql["delivery_rollup"] = V_ + ("SELECT webhook_id, count(*) FILTER (delivery_status = 'success') AS webhooks_triggered, count(*) FILTER (delivery_status <> 'success') AS webhooks_failed, "
                                   "0::BIGINT AS webhooks_skipped, max(response_time_ms) AS total_time_ms FROM v GROUP BY webhook_id")
    sql["delivery_details"] = V_ + "SELECT delivery_id, webhook_id, delivery_status, coalesce(status_code, 0) AS status_code, response_time_ms, row_number() OVER (PARTITION BY webhook_id ORDER BY delivery_id) - 1 AS position FROM v"
    return sql
