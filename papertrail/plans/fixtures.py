"""Derived input views, as SQL in the common subset of Spark and DuckDB.

Every view covers the whole of its base tables, so the work grows with them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from papertrail.sources.readers import read_table

RENDERED = r"""
WITH o AS (
 SELECT o_orderkey AS k, c_name AS cn, o_custkey AS ck, n_name AS nn, o_orderdate AS d,
        CAST(round(o_totalprice*100) AS BIGINT) AS cents, o_orderkey % 6 AS t
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
li AS (
 SELECT l_orderkey AS k, count(*) AS n_lines, min(l_partkey) AS p1, max(l_partkey) AS p2, CAST(sum(l_quantity) AS BIGINT) AS q
 FROM lineitem GROUP BY l_orderkey)
SELECT o.k AS doc_id,
 CASE t WHEN 0 THEN 'invoice' WHEN 1 THEN 'receipt' WHEN 2 THEN 'contract' WHEN 3 THEN 'form' WHEN 4 THEN 'nda' ELSE 'document' END AS doc_type,
 CASE t
 WHEN 0 THEN concat(cn, ' Trading', chr(10),
   CASE WHEN o.k % 7 = 0 THEN '' ELSE concat('Invoice #INV-', CAST(o.k AS STRING), chr(10)) END,
   'Date: ', (lpad(CAST(month(d) AS STRING),2,'0') || '/' || lpad(CAST(day(d) AS STRING),2,'0') || '/' || CAST(year(d) AS STRING)), chr(10),
   'PO: PO-', CAST(ck AS STRING), chr(10),
   CASE WHEN n_lines IS NULL THEN '' ELSE concat('Item  Quantity', chr(10), 'Part ', CAST(p1 AS STRING), '  ', CAST(q AS STRING), chr(10), 'Part ', CAST(p2 AS STRING), '  ', CAST(n_lines AS STRING), chr(10)) END,
   CASE WHEN o.k % 4 = 0 THEN concat('Subtotal: $', (CASE WHEN (cents - cents % 9000 - CASE WHEN o.k % 8 = 0 THEN 0 ELSE 500 END) >= 100000 THEN concat(CAST(CAST(floor((cents - cents % 9000 - CASE WHEN o.k % 8 = 0 THEN 0 ELSE 500 END)/100000) AS BIGINT) AS STRING), ',', lpad(CAST(CAST(floor((cents - cents % 9000 - CASE WHEN o.k % 8 = 0 THEN 0 ELSE 500 END)/100) AS BIGINT)%1000 AS STRING),3,'0')) ELSE CAST(CAST(floor((cents - cents % 9000 - CASE WHEN o.k % 8 = 0 THEN 0 ELSE 500 END)/100) AS BIGINT) AS STRING) END || '.' || lpad(CAST((cents - cents % 9000 - CASE WHEN o.k % 8 = 0 THEN 0 ELSE 500 END)%100 AS STRING),2,'0')), chr(10)) ELSE '' END,
   'Tax: $', (CAST(CAST(floor((cents % 9000)/100) AS BIGINT) AS STRING) || '.' || lpad(CAST((cents % 9000)%100 AS STRING),2,'0')), chr(10),
   CASE WHEN o.k % 11 = 0 THEN '' ELSE concat('Amount: $', CASE WHEN o.k % 4 = 0 THEN (CASE WHEN (cents) >= 100000 THEN concat(CAST(CAST(floor((cents)/100000) AS BIGINT) AS STRING), ',', lpad(CAST(CAST(floor((cents)/100) AS BIGINT)%1000 AS STRING),3,'0')) ELSE CAST(CAST(floor((cents)/100) AS BIGINT) AS STRING) END || '.' || lpad(CAST((cents)%100 AS STRING),2,'0')) ELSE (CAST(CAST(floor((cents)/100) AS BIGINT) AS STRING) || '.' || lpad(CAST((cents)%100 AS STRING),2,'0')) END, chr(10)) END)
 WHEN 1 THEN concat('Shop ', nn, chr(10), 'Receipt #R-', CAST(o.k AS STRING), chr(10),
   CASE WHEN o.k % 5 = 0 THEN '' ELSE concat((lpad(CAST(month(d) AS STRING),2,'0') || '/' || lpad(CAST(day(d) AS STRING),2,'0') || '/' || CAST(year(d) AS STRING)), chr(10)) END,
   CASE o.k % 4 WHEN 0 THEN 'VISA **** 4242' WHEN 1 THEN 'Cash' WHEN 2 THEN 'Debit' ELSE 'Cheque' END, chr(10),
   'Total: $', (CAST(CAST(floor((cents)/100) AS BIGINT) AS STRING) || '.' || lpad(CAST((cents)%100 AS STRING),2,'0')), chr(10))
 WHEN 2 THEN concat('Agreement between ', cn, ' and Supplier ', nn, chr(10),
   'Effective ', (lpad(CAST(month(d) AS STRING),2,'0') || '/' || lpad(CAST(day(d) AS STRING),2,'0') || '/' || CAST(year(d) AS STRING)), chr(10), CASE WHEN o.k % 5 = 0 THEN '' ELSE concat('Termination ', (lpad(CAST(month(d + INTERVAL '365' DAY) AS STRING),2,'0') || '/' || lpad(CAST(day(d + INTERVAL '365' DAY) AS STRING),2,'0') || '/' || CAST(year(d + INTERVAL '365' DAY) AS STRING)), chr(10)) END,
   'Contract value: $', (CASE WHEN (cents) >= 100000 THEN concat(CAST(CAST(floor((cents)/100000) AS BIGINT) AS STRING), ',', lpad(CAST(CAST(floor((cents)/100) AS BIGINT)%1000 AS STRING),3,'0')) ELSE CAST(CAST(floor((cents)/100) AS BIGINT) AS STRING) END || '.' || lpad(CAST((cents)%100 AS STRING),2,'0')), chr(10))
 WHEN 3 THEN concat('Name: ', cn, chr(10), 'Email: user', CAST(ck AS STRING), CASE WHEN o.k % 5 = 0 THEN '' ELSE '@example.com' END, chr(10),
   'Phone: 555', CASE WHEN o.k % 4 = 0 THEN '-' ELSE '' END, '201', CASE WHEN o.k % 4 = 0 THEN '-' ELSE '' END, lpad(CAST(ck % 10000 AS STRING),4,'0'), chr(10))
 WHEN 4 THEN concat('NON-DISCLOSURE AGREEMENT', chr(10), 'AGREEMENT made this 3rd day of May, ', CAST(year(d) AS STRING), ' by and between ACME ', nn, ', a Delaware corporation ("Company") of record, and Recipient ', CAST(ck AS STRING), ', an individual ("Recipient").', chr(10),
   CASE WHEN o.k % 5 = 0 THEN '' ELSE concat('The term is ', CAST(o.k % 9 + 1 AS STRING), ' years', chr(10)) END,
   'Governed by the laws of Delaware.', chr(10), 'Contact: legal', CAST(ck AS STRING), '@example.com', chr(10), 'Name: Jane Roe', chr(10), 'Title: CEO', chr(10))
 ELSE concat('Memo ', CAST(o.k AS STRING), chr(10), 'Dated ', (lpad(CAST(month(d) AS STRING),2,'0') || '/' || lpad(CAST(day(d) AS STRING),2,'0') || '/' || CAST(year(d) AS STRING)), chr(10), 'Budget $', (CASE WHEN (cents) >= 100000 THEN concat(CAST(CAST(floor((cents)/100000) AS BIGINT) AS STRING), ',', lpad(CAST(CAST(floor((cents)/100) AS BIGINT)%1000 AS STRING),3,'0')) ELSE CAST(CAST(floor((cents)/100) AS BIGINT) AS STRING) END || '.' || lpad(CAST((cents)%100 AS STRING),2,'0')), chr(10), 'ops', CAST(ck AS STRING), '@example.com', chr(10)) END AS text
FROM o LEFT JOIN li ON o.k = li.k
"""

MANIFEST = r"""
SELECT doc_id AS document_id, text, content_key, orig_name AS original_filename,
       CASE WHEN doc_id % 97 = 0 THEN 0 ELSE n_chars * 4096 END AS file_size,
       CASE doc_id % 6 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'image/tiff' WHEN 4 THEN 'text/plain' ELSE NULL END AS content_type
FROM (
  SELECT doc_id, text, n_chars, md5(text) AS content_key,
    concat(
      CASE WHEN doc_id % 23 = 0 THEN '../' WHEN doc_id % 29 = 0 THEN '~' WHEN doc_id % 31 = 0 THEN concat('a', chr(92))
           WHEN doc_id % 37 = 0 THEN concat('x', chr(10)) WHEN doc_id % 41 = 0 THEN 'a//' WHEN doc_id % 43 = 0 THEN 'in/'
           WHEN doc_id % 47 = 0 THEN repeat('a', 5000) WHEN doc_id % 53 = 0 THEN concat('c', chr(1)) ELSE '' END,
      CASE doc_id % 14 WHEN 0 THEN 'Invoice_' WHEN 1 THEN 'bill-' WHEN 2 THEN 'receipt ' WHEN 3 THEN 'payment_' WHEN 4 THEN 'Contract_'
           WHEN 5 THEN 'terms_' WHEN 6 THEN 'NDA-' WHEN 7 THEN 'agenda_' WHEN 8 THEN 'application_' WHEN 9 THEN 'information_'
           WHEN 10 THEN 'inv' WHEN 11 THEN 'rcpt_' WHEN 12 THEN 'rec' ELSE 'scan_' END,
      CAST(doc_id AS STRING),
      CASE doc_id % 9 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.jpg' WHEN 3 THEN '.jpeg' WHEN 4 THEN '.tiff' WHEN 5 THEN '.bmp'
           WHEN 6 THEN '.docx' WHEN 7 THEN '.tar.gz' ELSE '' END) AS orig_name
  FROM documents) x
"""

TEXT_PAGES = r"""
SELECT conv_id AS document_id, turn + 1 AS page_number,
       CASE WHEN (conv_id + turn) % 13 = 0 THEN '' ELSE text END AS text,
       CASE WHEN role = 'system' THEN 'fallback' ELSE 'primary' END AS method,
       CAST(CASE WHEN role = 'system' THEN 0.7 ELSE 0.95 END AS DOUBLE) AS confidence
FROM conversations
"""

TASK_LOG = r"""
SELECT event_id, user_id AS job_id, ts,
       CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'STARTED' WHEN 'click' THEN 'RETRY' WHEN 'purchase' THEN 'SUCCESS' ELSE 'FAILURE' END AS task_status,
       CASE event_id % 5 WHEN 0 THEN 'classification' WHEN 1 THEN 'ocr' WHEN 2 THEN 'analysis' WHEN 3 THEN 'schema' ELSE 'validation' END AS stage,
       CAST(round(value * 1000) AS BIGINT) AS duration_ms
FROM events
"""

WEBHOOK_LOG = r"""
SELECT c_custkey % 20 AS webhook_id, c_custkey AS seq,
       CASE WHEN c_custkey % 100 < 20 THEN 'register' WHEN c_custkey % 10 = 9 THEN 'delete' ELSE 'update' END AS op,
       CASE WHEN c_custkey % 100 < 20 OR c_custkey % 3 = 0 THEN concat('https://hooks.example.com/', CAST(c_custkey AS STRING)) ELSE NULL END AS url,
       CASE WHEN c_custkey % 100 < 20 OR c_custkey % 4 = 1 THEN c_custkey % 5 <> 0 ELSE NULL END AS active,
       CASE WHEN c_custkey % 100 < 20 OR c_custkey % 7 = 2 THEN CASE WHEN c_custkey % 2 = 0 THEN 'document.processed' ELSE 'document.failed,document.processed' END ELSE NULL END AS events_csv
FROM customer
"""

DELIVERIES = r"""
SELECT event_id AS delivery_id, user_id % 20 AS webhook_id, ts,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(element AS INT) END AS status_code,
       CASE WHEN event_id % 17 <> 0 THEN NULL WHEN event_id % 2 = 0 THEN 'timeout' ELSE 'request_error' END AS transport_error,
       CAST(round(value * 1000) AS BIGINT) AS response_time_ms
FROM (SELECT *, CASE event_id % 6 WHEN 0 THEN '200' WHEN 1 THEN '204' WHEN 2 THEN '302' WHEN 3 THEN '404' WHEN 4 THEN '500' ELSE '201' END AS element FROM events) e
"""

# A rule table that grows: one rule per supplier, over all types and lookups (name, dotted name, last part, none).
SUPPLIER_RULES = r"""
SELECT CASE s_suppkey % 7 WHEN 0 THEN 'invoice' WHEN 1 THEN 'receipt' WHEN 2 THEN 'contract' WHEN 3 THEN 'form' WHEN 4 THEN 'nda'
            WHEN 5 THEN 'document' ELSE '*' END AS document_type,
       CAST(s_suppkey AS INT) AS position,
       CASE s_suppkey % 11 WHEN 0 THEN 'total_amount' WHEN 1 THEN 'vendor.name' WHEN 2 THEN 'receipt_number' WHEN 3 THEN 'amounts_total'
            WHEN 4 THEN 'payment_method' WHEN 5 THEN 'contract_value' WHEN 6 THEN 'party1' WHEN 7 THEN 'term_duration'
            WHEN 8 THEN 'contact_email_1' WHEN 9 THEN 'own.code' ELSE 'dates.date' END AS field,
       CASE s_suppkey % 3 WHEN 0 THEN 'range' WHEN 1 THEN 'required' ELSE 'regex' END AS rule,
       CAST(NULL AS STRING) AS fmt,
       CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal END AS min_val,
       CASE WHEN s_suppkey % 6 = 0 THEN s_acctbal * 4 END AS max_val,
       CASE WHEN s_suppkey % 3 = 2 THEN '[A-M0-4]' END AS pattern,
       concat('Rule ', CAST(s_suppkey AS STRING)) AS message,
       CASE WHEN s_suppkey % 2 = 0 THEN 'error' ELSE 'warning' END AS severity
FROM supplier
"""

VIEWS = {
    "rendered": (RENDERED, ("orders", "customer", "nation", "lineitem")),
    "manifest": (MANIFEST, ("documents",)),
    "supplier_rules": (SUPPLIER_RULES, ("supplier",)),
    "text_pages": (TEXT_PAGES, ("conversations",)),
    "task_log": (TASK_LOG, ("events",)),
    "webhook_log": (WEBHOOK_LOG, ("customer",)),
    "deliveries": (DELIVERIES, ("events",)),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def bound_sql(name: str) -> str:
    """The view's SQL with its base tables as ``{name}`` parameters."""
    sql, bases = VIEWS[name]
    return re.sub(rf"\b(FROM|JOIN) ({'|'.join(bases)})\b", r"\1 {\2}", sql)


#: Session setting: into how many partitions a view of texts is dealt.  Without it the manifest is split as its tables are read,
#: the rendered texts as below; the library's readers leave splits to the session.
SPLITS = "papertrail.view.splits"
_TEXTS = ("rendered", "manifest")
#: Tasks a core, for rendered texts.  Their rows come out of a join whose partitions are sized for its narrow rows: some more than
#: there are cores, or one, when all that is costly comes after.  Larger tables have more splits, so tasks stay of a size.
_TASKS = 3


def _dealt(spark: SparkSession, sf_dir: str) -> int:
    return _TASKS * max(spark.sparkContext.defaultParallelism, table(spark, sf_dir, "orders").rdd.getNumPartitions())


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.sql(bound_sql(name), **{b: table(spark, sf_dir, b) for b in VIEWS[name][1]})
    splits = spark.conf.get(SPLITS, None)
    if splits and name in _TEXTS:
        return rows.repartition(int(splits), rows.columns[0])
    # By the text as well: ids may be missing or repeated.
    return rows.repartition(_dealt(spark, sf_dir), "doc_id", "text") if name == "rendered" else rows
