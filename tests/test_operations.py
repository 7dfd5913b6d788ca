"""Folds, joins and assembly against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from papertrail.operators import admission as A, assemble as B, classify as C, lifecycle as H, webhooks as I
from papertrail.sources import readers, sinks

START = dt.datetime(2024, 1, 1)
STATUSES = ["PENDING", "STARTED", "RETRY", "SUCCESS", "FAILURE"]


def event_log(spark, n=400, jobs=7, seed=3):
    """Half of the events belong to one job; ties in time are ordered by id."""
    rng = random.Random(seed)
    rows = [(i, 0 if rng.random() < 0.5 else rng.randrange(jobs), START + dt.timedelta(seconds=rng.randrange(600)),
             rng.choice(STATUSES), rng.choice(["classification", "ocr", "analysis", "schema", "validation"]), rng.randrange(100)) for i in range(n)]
    df = spark.createDataFrame(rows, "event_id bigint, job_id bigint, ts timestamp_ntz, task_status string, stage string, duration_ms bigint")
    return rows, df


def test_current_state_and_failures(spark):
    rows, df = event_log(spark)
    got = {r.job_id: r for r in H.current_state(df).collect()}
    lost = {r.job_id: r for r in H.failure_state(df.withColumn("error", F.concat(F.lit("e"), "event_id")), "error").collect()}
    for job in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == job), key=lambda r: (r[2], r[0]))
        assert (got[job].event_id, got[job].task_status, got[job].uploaded_at) == (mine[-1][0], mine[-1][3], mine[0][2])
        failures = [r for r in mine if r[3] == "FAILURE"]
        assert lost[job].n_failures == len(failures) and lost[job].error == (f"e{failures[-1][0]}" if failures else None)


def test_rate_admission(spark):
    rows, df = event_log(spark)
    got = {r.event_id: r.admitted for r in H.rate_admission(df, "job_id", "1 minute", 5).collect()}
    assert len(got) == len(rows)
    seen = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        key = (r[1], r[2].replace(second=0))
        seen[key] = seen.get(key, 0) + 1
        assert got[r[0]] == (seen[key] <= 5)
    counts = {(r.job_id, r.window_start): r.n_requests for r in H.rate_windows(df, "job_id", "1 minute", 5).collect()}
    assert counts == seen


def test_attempts(spark):
    t = lambda s: START + dt.timedelta(seconds=s)
    rows = [(1, 1, t(0), "PENDING", "ocr"), (2, 1, t(1), "RETRY", "ocr"), (3, 1, t(2), "RETRY", "ocr"), (4, 1, t(9), "SUCCESS", "ocr"),
            (5, 2, t(0), "RETRY", "ocr"), (6, 2, t(1), "RETRY", "ocr"), (7, 3, t(0), "RETRY", "ocr"), (8, 3, t(1), "RETRY", "ocr"), (9, 3, t(2), "RETRY", "ocr"),
            (10, 4, t(0), "STARTED", "analysis"), (11, 5, t(0), "PENDING", "analysis"), (12, 5, t(3), "FAILURE", "analysis")]
    df = spark.createDataFrame(rows, "event_id bigint, job_id bigint, ts timestamp_ntz, task_status string, stage string") \
        .withColumn("error", F.when(F.col("task_status").isin("RETRY", "FAILURE"), F.concat(F.lit("e"), "event_id")))
    runs = H.attempt_fold(df, "error")
    got = {r.job_id: (r.status, r.retry_count, r.error_count, r.duration_ms, r.error) for r in runs.collect()}
    assert got == {1: ("completed", 2, 2, 9000, "e3"), 2: ("retrying", 2, 2, 1000, "e6"), 3: ("failed", 3, 3, 2000, "e9"),
                   4: ("running", 0, 0, 0, None), 5: ("failed", 0, 1, 3000, "e12")}
    folded = {r.job_id: (r.stage, r.failed_stage, r.error) for r in H.fold_stage_runs(runs, "job_id").collect()}
    assert folded[3] == ("failed", "ocr", "OCR failed: e9") and folded[1] == ("classification", None, None)


def test_open_stages(spark):
    order = ["classification", "ocr", "analysis", "schema", "validation"]
    jobs = {1: ["completed"] * 5, 2: ["completed", "running"], 3: ["pending"], 4: ["completed", "completed", None, "completed", "completed"],
            5: ["completed", "running", "failed", "failed"], 6: [None, None, None, None, "retrying"]}
    rows = [(j, s, status, f"e{j}{s}") for j, statuses in jobs.items() for s, status in zip(order, statuses) if status]
    runs = spark.createDataFrame(rows, "document_id int, stage string, status string, error string")
    got = {r.document_id: (r.stage, r.failed_stage, r.error) for r in H.fold_stage_runs(runs).collect()}
    assert got == {1: ("completed", None, None), 2: ("ocr", None, None), 3: ("classification", None, None), 4: ("analysis", None, None),
                   5: ("failed", "analysis", "Analysis failed: e5analysis"), 6: ("classification", None, None)}


def test_nulls_stay(spark):
    rows = [(1, None, START), (2, None, START), (3, 7, None), (4, 7, START)]
    log = spark.createDataFrame(rows, "event_id bigint, client int, ts timestamp_ntz")
    got = {r.event_id: r.admitted for r in H.rate_admission(log, "client", "1 minute", 1).collect()}
    assert got == {1: True, 2: False, 3: None, 4: True}
    hashed = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "a")], "document_id int, content_hash string")
    assert sorted(r.document_id for r in A.first_copies(hashed).collect()) == [1, 2, 3]
    assert [r.content_hash for r in A.copy_groups(hashed).collect()] == ["a"]


def test_recovery_and_retry(spark):
    rows = [(1, 1, START, "PENDING", "ocr"), (2, 2, START + dt.timedelta(minutes=6), "PENDING", "ocr"), (3, 3, START, "SUCCESS", "ocr")]
    state = H.current_state(spark.createDataFrame(rows, "event_id bigint, job_id bigint, ts timestamp_ntz, task_status string, stage string"))
    as_of = F.lit(START + dt.timedelta(minutes=10)).cast("timestamp_ntz")
    assert [r.file_path for r in H.recovery_queue(state, as_of, suffix=F.lit(".png")).collect()] == ["1.png"]
    assert sorted(r.job_id for r in H.stuck_tasks(state, as_of).collect()) == [1, 2]
    ids = spark.createDataFrame([(3,), (9,)], "job_id bigint")
    row, = H.retry_rows(state, ids).collect()
    assert (row.job_id, row.old_task_id, row.manual_retry, row.status) == (3, 3, True, "processing")
    assert readers.lookup(state, [1, 2], "job_id").count() == 2


def test_registry_equals_a_replay(spark):
    rng = random.Random(5)
    log, store = [], {}
    for seq in range(600):
        key, op = rng.choice([0, 0, 0, 1, 2, 3]), rng.choice(["register", "update", "update", "delete"])
        values = {"url": rng.choice([None, f"u{seq}"]), "active": rng.choice([None, True, False]), "events": rng.choice([None, ["a"], ["a", "b"]])}
        log.append((key, seq, op, *values.values()))
        if op == "register":
            store[key] = {"url": values["url"], "active": True if values["active"] is None else values["active"], "events": values["events"] or ["document.processed"]}
        elif op == "update" and key in store:
            store[key].update({k: v for k, v in values.items() if v is not None})
        elif op == "delete":
            store.pop(key, None)
    df = spark.createDataFrame(log, "webhook_id int, seq int, op string, url string, active boolean, events array<string>")
    got = {r.webhook_id: {"url": r.url, "active": r.active, "events": r.events} for r in I.registry(df).collect()}
    assert got == store


def test_subscriptions_and_outbox(spark):
    hooks = spark.createDataFrame([(1, "u1", True, ["document.processed"]), (2, "u2", True, ["document.failed"]), (3, "u3", False, ["document.processed"]),
                                   (4, "u4", None, None), (5, "u5", True, None)], "webhook_id int, url string, active boolean, events array<string>")
    docs = spark.createDataFrame([(i, "document.processed") for i in range(5)], "document_id int, event string")
    got = {(r.document_id, r.webhook_id): (r.delivery_status, r.reason) for r in I.match_subscriptions(docs, hooks).collect()}
    assert len(got) == 10 and got[0, 1] == ("eligible", None) and got[0, 5] == ("eligible", None)
    unknown = docs.withColumn("event", F.lit("document.unheard_of")).union(docs)
    skips = {(r.event, r.webhook_id): r.n_events for r in I.skipped_subscriptions(unknown, hooks).collect()}
    assert skips == {("document.processed", 2): 5, **{("document.unheard_of", w): 5 for w in (1, 2, 5)}}
    gated = spark.createDataFrame([(1, True, "completed"), (2, True, "ocr"), (3, False, "completed")], "document_id int, is_valid boolean, stage string")
    assert [r.document_id for r in I.delivery_gate(gated).collect()] == [1]
    sent = I.outbox(I.match_subscriptions(docs, hooks))
    assert sent.count() == 10 and sent.select("delivery_id").distinct().count() == 10
    def sender(row):
        if row.webhook_id == 5:
            raise OSError("refused")
        return 204, None, 12
    out = sinks.send(sent, sender).withColumn("delivery_status", I.outcome(F.col("status_code"), F.col("transport_error")))
    report = {r.webhook_id: (r.webhooks_triggered, r.webhooks_failed, r.total_time_ms) for r in I.delivery_rollup(out, "webhook_id").collect()}
    assert report == {1: (5, 0, 12), 5: (0, 5, 0)}


@pytest.mark.parametrize("code,error,want", [(200, None, "success"), (299, None, "success"), (302, None, "failed"), (500, None, "failed"),
                                             (None, "timeout", "timeout"), (None, "request_error", "error"), (None, None, "failed")])
def test_outcome(spark, code, error, want):
    df = spark.createDataFrame([(code, error)], "c int, e string")
    assert df.select(I.outcome(F.col("c"), F.col("e"))).first()[0] == want


def test_pages_in_segments(spark):
    pages = [(d, p, "" if (d + p) % 5 == 0 else f"p{p} of {d}", 0.5 + 0.1 * (p % 3)) for d, n in ((1, 40), (2, 3), (3, 9)) for p in range(0, n + 1)]
    random.Random(1).shuffle(pages)
    df = spark.createDataFrame(pages, "document_id int, page_number int, text string, confidence double")
    want = {}
    for d, p, t, c in sorted(pages):
        if t:
            want.setdefault(d, []).append((t, c))
    for size in (512, 4, 1):
        rows = B.assemble_pages(df, size).collect()
        got = {r.document_id: r for r in rows}
        assert len(rows) == len(got)
        assert set(got) == set(want)
        for d, ps in want.items():
            assert got[d].total_pages == len(ps) and abs(got[d].average_confidence - sum(c for _, c in ps) / len(ps)) < 1e-9
            text = "\n\n".join(t for t, _ in ps)
            assert got[d].full_text == text and got[d].n_words == len(text.split())
            parts = sorted((r.segment, r.text) for r in B.page_segments(df, size).filter(f"document_id = {d}").collect())
            assert "\n\n".join(t for _, t in parts) == text


def test_word_count_is_a_split(spark):
    texts = ["a b", "  a  b\n", "x y", "a\x1cb", " c d", "", "one"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", B.word_count(F.col("t")).alias("n")).collect():
        assert r.n == len(r.t.split()), repr(r.t)


def test_sources_of_text(spark):
    rows = [(1, "primary", "a", 0.95, "image/png"), (1, "fallback", "b", 0.7, "image/png"), (2, "primary", "", 0.95, "application/pdf"),
            (2, "fallback", "b", 0.7, "application/pdf"), (3, "fallback", "b", 0.7, "image/png")]
    df = spark.createDataFrame(rows, "document_id int, method string, text string, confidence double, mime_type string")
    got = {r.document_id: (r.source, r.n_pages, r.average_confidence) for r in B.pick_source(df).collect()}
    assert got == {1: ("primary", 1, 0.95), 2: ("fallback", 1, 0.7), 3: ("empty", 0, 0.0)}


def test_admission_order_and_copies(spark):
    big = 60 * 1024 * 1024
    rows = [(1, "a.pdf", 10, "x"), (2, None, 10, "x"), (3, "../a.pdf", big, "y"), (4, "a.txt", big, "z"), (5, "a.PDF", big, "z"), (6, "a.pdf", 0, "w"), (7, "a.tif", 5, "z")]
    df = spark.createDataFrame(rows, "document_id int, original_filename string, file_size long, content string")
    got = {r.document_id: (r.reject_reason, r.status_code) for r in A.admit(df).collect()}
    assert got == {1: (None, 202), 2: ("name_missing", 400), 3: ("unsafe_name", 400), 4: ("extension_not_allowed", 400), 5: ("too_large", 413),
                   6: ("empty_file", 400), 7: ("extension_not_allowed", 400)}
    hashed = A.build_manifest(df, content="content")
    assert sorted(r.document_id for r in A.first_copies(hashed).collect()) == [1, 3, 4, 6]
    assert {(r.n_copies, r.first_id) for r in A.copy_groups(hashed).collect()} == {(2, 1), (3, 4)}


@pytest.mark.parametrize("name,want", [("agenda.pdf", "nda"), ("information.pdf", "form"), ("Total_bill.pdf", "invoice"), ("inv7.pdf", "invoice"), ("rcpt.pdf", "receipt"),
                                       ("terms.pdf", "contract"), ("scan.pdf", "document"), ("proprietary information.pdf", "nda"), ("record.pdf", "receipt")])
def test_type_by_name(spark, name, want):
    df = spark.createDataFrame([(name, 1, None)], "original_filename string, file_size int, content_type string")
    row = C.classify(df).first()
    assert row.document_type == want and row.mime_type == "application/pdf" and row.is_supported
    assert abs(row.confidence - (0.8 if want == "document" else 1.0)) < 1e-9


def test_files_and_extraction(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"hello")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.txt").write_bytes(b"x" * 50)
    files = readers.read_files(spark, str(tmp_path), max_bytes=20)
    assert {r.original_filename: (r.file_size, r.content is None) for r in files.collect()} == {"a.txt": (5, False), "b.txt": (2, False), "c.txt": (50, True)}
    def strict(content):
        return content.decode("utf-8")
    got = {r.original_filename: (r.text, r.error) for r in B.extract_text(files, "original_filename", strict).collect()}
    assert got["a.txt"] == ("hello", None) and got["b.txt"][0] is None and got["b.txt"][1].startswith("UnicodeDecodeError") and got["c.txt"] == (None, None)


def test_record_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "invoice", "{}"), (2, "form", "{}")], "document_id int, document_type string, schema_json string")
    for _ in range(2):
        sinks.write_records(df, str(tmp_path / "r"))
    assert sinks.read_records(spark, str(tmp_path / "r")).count() == 2
    assert sinks.read_record(spark, str(tmp_path / "r"), 2).first().document_type == "form"
    later = spark.createDataFrame([(3, "invoice", "{}"), (2, "invoice", "{}")], df.schema)
    for _ in range(2):  # another batch of the same type, and its replay
        sinks.write_records(later, str(tmp_path / "r"), 1)
    got = {r.document_id: r.document_type for r in sinks.read_records(spark, str(tmp_path / "r")).collect()}
    assert got == {1: "invoice", 2: "invoice", 3: "invoice"}
    assert [r.document_type for r in sinks.read_record(spark, str(tmp_path / "r"), 2).collect()] == ["invoice"]


def test_result_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "completed")], "job_id int, status string")
    for batch in (0, 1, 1):
        sinks.write_results(str(tmp_path), batch, job_results=df, stage_runs=df)
    sinks.write_results(str(tmp_path), 2, job_results=df)   # a batch that broke off after its first table
    read = sinks.read_results(spark, str(tmp_path), "job_results", "stage_runs")
    assert {name: df.count() for name, df in read.items()} == {"job_results": 2, "stage_runs": 2}


def test_outbox_after_a_crash(spark, tmp_path):
    out = tmp_path / "o"
    (out / "run=0-0.0" / "_temporary").mkdir(parents=True)
    sent = spark.createDataFrame([("a", 1), ("b", 2)], "delivery_id string, v int")
    sinks.append_outbox(sent, str(out), 0)
    sinks.append_outbox(sent, str(out), 1)
    assert sinks.read_outbox(spark, str(out)).count() == 2
    sinks.append_outbox(sent, str(out), 500)
    assert sinks.read_outbox(spark, str(out)).count() == 2 and sinks.read_outbox(spark, str(out), 500).count() == 0


def test_delivery_ledger(spark):
    t = lambda s: None if s is None else START + dt.timedelta(seconds=s)
    outbox = spark.createDataFrame([(k, "u") for k in "abcdefg"], "delivery_id string, url string")
    tried = [("b", 0, "failed"), ("c", 0, "failed"), ("c", 10, "success"), ("c", 20, "failed"), ("d", 0, "timeout"), ("d", 50, "error"),
             *[("e", 10 * i, "failed") for i in range(3)], ("f", None, "failed"), ("g", 5, "skipped"), ("zz", 0, "failed")]
    attempts = spark.createDataFrame([(k, t(s), o) for k, s, o in tried], "delivery_id string, attempted_at timestamp, delivery_status string")
    found = I.delivery_ledger(outbox, attempts, F.lit(START + dt.timedelta(seconds=100)), max_retries=2, delay_seconds=30, growth=2.0)
    got = {r.delivery_id: (r.n_attempts, r.last_status, r.next_attempt_at, r.ledger) for r in found.collect()}
    assert got == {"a": (0, None, None, "new"), "b": (1, "failed", t(30), "due"), "c": (3, "failed", None, "delivered"),
                   "d": (2, "error", t(110), "waiting"), "e": (3, "failed", None, "exhausted"), "f": (1, "failed", t(100), "due"),
                   "g": (0, None, None, "new")}
    assert sorted(r.delivery_id for r in I.due_deliveries(found).collect()) == ["a", "b", "f", "g"]


def test_positions_across_parts(spark):
    """A hot key, null keys and null ids, few and many parts: positions are those of one sorted list per key."""
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), None if i == 7 else f"{rng.getrandbits(40):010x}", "success", 200, i) for i in range(400)]
    schema = "webhook_id int, delivery_id string, delivery_status string, status_code int, response_time_ms int"
    sent = spark.createDataFrame(rows, schema).repartition(5)
    want = {}
    for key, id_, *_, ms in sorted(rows, key=lambda r: (str(r[0]), r[1] or "")):
        want[ms] = sum(r[0] == key and (r[1] or "") < (id_ or "") for r in rows)
    for part in (None, F.substring("delivery_id", 1, 1), F.lit(0)):
        found = I.delivery_details(sent, "webhook_id", part=part)
        assert found.columns == [*sent.columns[:2], *sent.columns[2:], "position"]
        assert {r.response_time_ms: r.position for r in found.collect()} == want
    assert I.delivery_details(sent.filter("false"), "webhook_id").collect() == []
    with pytest.raises(ValueError, match="give the part"):
        I.delivery_details(sent.withColumn("delivery_id", F.lit(1)), "webhook_id")


def test_positions_sort_no_whole_key(spark):
    """Rows are numbered within (key, part); the only window over a whole key is over counts."""
    schema = "webhook_id int, delivery_id string, delivery_status string, status_code int, response_time_ms int"
    plan = I.delivery_details(spark.createDataFrame([], schema), "webhook_id")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2
    assert all("_part" in line.rsplit("], [", 2)[1] for line in windows if "row_number()" in line)
