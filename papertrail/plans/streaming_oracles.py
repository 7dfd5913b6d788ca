"""DuckDB SQL for the streaming jobs' result tables."""

from __future__ import annotations

from papertrail import fixed_values as V
from papertrail.operators.validate import rule_rows
from papertrail.plans import document_oracles as D, operations_oracles as O


def _flow() -> str:
    """Admitted, extractable manifest rows as the ``docs`` of the document oracles."""
    body = D.flow()
    assert body.startswith(D.DOCS)
    docs = (f"docs AS MATERIALIZED (SELECT 'documents' AS corpus, document_id AS doc_id, text, CASE WHEN {D.nda_test()} THEN 'nda' ELSE {O.name_type('lower(safe_name)')} END "
            f"AS document_type FROM m WHERE reject_reason IS NULL AND file_size <= {V.MAX_EXTRACT_BYTES} AND text <> '')")
    return O.M + ", " + docs + body[len(D.DOCS):] + ", " + D.checks_cte(rule_rows())


def oracles() -> dict[str, str]:
    flow = _flow()
    valid = "count(*) FILTER (NOT passed AND severity = 'error') = 0"
    sql = {
        "stream_ingest": flow + (
            f" SELECT c.doc_id AS document_id, c.document_type, coalesce(any_value(f.n), 0) AS fields_above_threshold, {valid} AS is_valid, count(*) AS total_checks "
            "FROM checks c LEFT JOIN (SELECT doc_id, count(*) AS n FROM fields GROUP BY doc_id) f ON f.doc_id = c.doc_id GROUP BY c.doc_id, c.document_type"),
        "stream_quarantine": O.M + (
            f", s AS (SELECT document_id, reject_reason, CASE WHEN reject_reason IS NOT NULL THEN 'classification' WHEN file_size > {V.MAX_EXTRACT_BYTES} THEN 'ocr' "
            "WHEN coalesce(text, '') = '' THEN 'analysis' END AS failed_stage FROM m) SELECT document_id, 'failed' AS stage, failed_stage, "
            "CASE failed_stage WHEN 'classification' THEN reject_reason WHEN 'ocr' THEN 'too_large_to_extract' ELSE 'no text to analyze' END AS error FROM s WHERE failed_stage IS NOT NULL"),
        "stream_dedup": "SELECT md5(text) AS content_hash, min(doc_id) AS doc_id FROM documents GROUP BY md5(text)",
        "stream_state": O.L + "SELECT job_id, event_id, task_status, stage, n_events FROM last",
        "stream_stuck": O.L + (
            ", mark AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM l WHERE task_status IN ('PENDING', 'SUCCESS', 'FAILURE')) "
            "SELECT job_id, event_id FROM l p, mark WHERE task_status = 'PENDING' AND ts + INTERVAL 5 MINUTE <= w AND NOT EXISTS (SELECT 1 FROM l t WHERE t.job_id = p.job_id "
            "AND t.task_status IN ('SUCCESS', 'FAILURE') AND t.ts > p.ts AND t.ts <= p.ts + INTERVAL 5 MINUTE)"),
        "stream_rate": O.L + (
            "SELECT job_id, date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS n_requests, count(*) > 5 AS exceeded FROM l GROUP BY ALL "
            "HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM l) - INTERVAL 10 MINUTE"),
        "stream_admit": O.L + (
            "SELECT event_id, job_id, row_number() OVER (PARTITION BY job_id, date_trunc('day', ts) ORDER BY ts, event_id) <= 5 AS admitted FROM l"),
        "stream_outbox": flow + f", {O.REG}, gated AS (SELECT doc_id FROM checks GROUP BY doc_id HAVING {valid}) " + (
            "SELECT sha256(concat_ws('|', CAST(doc_id AS VARCHAR), CAST(webhook_id AS VARCHAR), 'document.processed')) AS delivery_id, doc_id AS document_id, webhook_id "
            "FROM gated, reg WHERE active AND list_contains(string_split(events_csv, ','), 'document.processed')"),
    }
    return sql
