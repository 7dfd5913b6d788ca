"""Streams against the batch operators, with several micro-batches, late events and replays."""

import datetime as dt
import os
import random

import numpy as np
from pyspark.sql import functions as F

from papertrail.operators import lifecycle as H
from papertrail.sources import sinks
from papertrail.sources.readers import stream_files, stream_table
from papertrail.streaming import jobs
from papertrail.streaming.overdue import ended, ended_by_key, thinned, thinned_by_key
from tests.test_operations import START, event_log


def stream_of(spark, df, folder, files=4):
    df.repartition(files).write.mode("overwrite").parquet(folder)
    return stream_table(spark, folder, df.schema, files_per_batch=1)


def in_turn(folder, k):
    """The one file of part ``k`` as the stream's ``k``-th batch."""
    for file in (folder / f"p={k}").glob("*.parquet"):
        file.rename(folder / f"{k}.parquet")
        os.utime(folder / f"{k}.parquet", (1_700_000_000 + 60 * k,) * 2)


def with_time(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def test_state_equals_batch_and_survives_replay(spark, tmp_path):
    _, log = event_log(spark, 300)
    log = with_time(log)
    stream = stream_of(spark, log, str(tmp_path / "in"))
    out = str(tmp_path / "state")
    jobs.finish(jobs.track_state(stream, out, str(tmp_path / "c1")))
    assert len(list((tmp_path / "state").glob("run=*"))) > 1
    want = {r.job_id: (r.event_id, r.n_events) for r in H.current_state(log).collect()}

    def got(path):
        return {r.job_id: (r["last"].event_id, r.n_events) for r in jobs.read_state(spark, path).collect()}
    assert got(out) == want
    jobs.finish(jobs.track_state(stream, out, str(tmp_path / "c2")))   # a full replay writes the same batches again
    assert got(out) == want
    assert jobs.compact_state(spark, out, str(tmp_path / "c1")) >= 1
    assert len(jobs.state_store(spark, out).runs()) == 1 and got(out) == want
    live = jobs.read_state(spark, out, ttl_seconds=1, as_of=F.lit(START + dt.timedelta(days=1)))
    assert live.count() == 0


def test_rate_windows(spark, tmp_path):
    _, log = event_log(spark, 300)
    last = spark.createDataFrame([(9999, 99, START + dt.timedelta(days=2), "PENDING", "ocr", 1)], log.schema)
    stream = stream_of(spark, with_time(log.unionByName(last)), str(tmp_path / "in"), files=1)
    jobs.finish(jobs.rate_windows(stream, str(tmp_path / "out"), str(tmp_path / "c"), "job_id", "1 minute", 5))
    got = {(r.job_id, r.window_start): (r.n_requests, r.exceeded) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.job_id, r.window_start): (r.n_requests, r.exceeded) for r in H.rate_windows(with_time(log), "job_id", "1 minute", 5).collect()}
    assert got == want


def test_stuck(spark, tmp_path):
    t = lambda m: START + dt.timedelta(minutes=m)
    rows = [(1, 1, t(0), "PENDING"), (2, 1, t(4), "SUCCESS"), (3, 2, t(0), "PENDING"), (4, 2, t(6), "SUCCESS"), (5, 3, t(1), "PENDING"),
            (6, 9, t(600), "PENDING"), (7, 9, t(601), "SUCCESS")]
    df = spark.createDataFrame(rows, "event_id bigint, job_id bigint, ts timestamp, task_status string")
    stream = stream_of(spark, df, str(tmp_path / "in"), files=1)
    jobs.finish(jobs.stuck(stream, str(tmp_path / "out"), str(tmp_path / "c")))
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [3, 5]


def stuck_ids(events, reach=5):
    """(event ids) of PENDING events without a terminal one of their key in time, as far as the watermark has come."""
    mark = max(t for _, _, t, s in events if s != "RETRY") - dt.timedelta(minutes=10)
    ends = [(k, t) for _, k, t, s in events if s in ("SUCCESS", "FAILURE") and k is not None]
    return sorted(i for i, k, t, s in events if s == "PENDING" and t + dt.timedelta(minutes=reach) <= mark
                  and not any(k == key and t < at <= t + dt.timedelta(minutes=reach) for key, at in ends))


LOG = "event_id bigint, job_id bigint, ts timestamp, task_status string"


def test_stuck_out_of_order_over_batches(spark, tmp_path):
    """Several batches, each in any order, terminal events before and after what they end; keys may be null."""
    rng = random.Random(5)
    events = [(i, rng.choice([1, 2, 3, None]), START + dt.timedelta(seconds=i * 3 + rng.randrange(-200, 200), microseconds=rng.randrange(10**6)),
               rng.choice(["PENDING", "PENDING", "SUCCESS", "FAILURE", "RETRY"]) if i % 11 else "PENDING") for i in range(700)]
    events = [e for e in events if not (e[3] in ("SUCCESS", "FAILURE") and e[0] % 3)]
    folder = tmp_path / "in"
    for part in range(3):
        spark.createDataFrame(events[part * 200:part * 200 + 200], LOG).coalesce(1).write.parquet(str(folder / f"p={part}"))
        in_turn(folder, part)
    stream = stream_table(spark, str(folder), spark.createDataFrame([], LOG).schema, files_per_batch=1)
    jobs.finish(jobs.stuck(stream, str(tmp_path / "out"), str(tmp_path / "c")))
    got = sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == stuck_ids(events[:600]) and len(got) > 20


def test_stuck_state_of_a_hot_job_is_bounded(spark, tmp_path):
    """100 000 events of one job: rows of state are its open minutes and one of terminal times."""
    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 20_000)
    status = F.when(F.col("id") % 2 == 0, "PENDING").otherwise("SUCCESS")
    log = spark.range(100_000).select(F.col("id").alias("event_id"), F.lit(7).cast("long").alias("job_id"), at.alias("ts"),
                                      F.when(F.col("id").between(40_000, 80_000), "PENDING").otherwise(status).alias("task_status"))
    stream = stream_of(spark, log.orderBy("ts"), str(tmp_path / "in"), files=1)
    query = jobs.stuck(stream, str(tmp_path / "out"), str(tmp_path / "c"))
    jobs.finish(query)
    state = [o.numRowsTotal for p in query.recentProgress for o in p.stateOperators]
    # No end comes for 800 s: those pending for more than five minutes at its end are stuck, but for the last ten minutes.
    got = spark.read.parquet(str(tmp_path / "out")).count()
    late = [i for i in range(40_000, 80_001) if (80_001 - i) * 0.02 > 300 and i * 0.02 + 300 <= 99_999 * 0.02 - 600]
    assert got == len(late) > 10_000 and max(state) < 200


def test_thinned_times_answer_alike():
    rng = random.Random(2)
    for _ in range(300):
        times = np.array(sorted(rng.randrange(200) for _ in range(rng.randrange(40))), np.int64)
        kept = thinned(times, 20)
        since = np.arange(-30, 230)
        assert (ended(since, kept, 20) == ended(since, times, 20)).all()
        assert not len(kept) or len(kept) <= 2 * (200 // 20) + 3


def test_every_request_is_answered(spark, tmp_path):
    """A log in order of time, over several batches: the answers of the batch operator, one client with most requests."""
    log = spark.range(900).select(F.col("id").alias("event_id"), F.when(F.col("id") % 4 > 0, 1).when(F.col("id") % 8 == 0, 2).alias("job_id"),
                                  F.timestamp_millis(F.lit(1_700_000_000_123) + F.col("id") * 1500).alias("ts"), F.lit("x").alias("note"))
    folder = tmp_path / "in"
    for k in range(3):
        log.filter((F.col("event_id") / 300).cast("int") == k).coalesce(1).write.parquet(str(folder / f"p={k}"))
        in_turn(folder, k)
    stream = stream_table(spark, str(folder), log.schema, files_per_batch=1)
    jobs.finish(jobs.admit_requests(stream, str(tmp_path / "out"), str(tmp_path / "c"), "job_id", "1 minute", 7))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*log.columns, "admitted").collect()))
    assert got == sorted(map(tuple, H.rate_admission(log, "job_id", "1 minute", 7).collect())) and sum(r[-1] for r in got) > 100


def test_a_copy_40_days_later(spark, tmp_path):
    day = lambda d: START + dt.timedelta(days=d)
    parts = [[("x", day(0), 1), ("y", day(0), 2)], [("z", day(20), 3)], [("x", day(40), 5), ("v", day(40), 6)], [("w", day(1), 4)]]
    folder = tmp_path / "in"
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, "content_hash string, uploaded_at timestamp, id int").coalesce(1).write.parquet(str(folder / f"p={k}"))
        in_turn(folder, k)
    stream = stream_table(spark, str(folder), spark.createDataFrame([], "content_hash string, uploaded_at timestamp, id int").schema, files_per_batch=1)
    for name, delay, want in (("ever", None, [1, 2, 3, 4, 6]), ("mark", "10 minutes", [1, 2, 3, 6])):   # row 4 is later than the watermark
        for _ in range(2):   # the second run has nothing to do
            jobs.finish(jobs.first_ever(stream, str(tmp_path / name), str(tmp_path / f"c-{name}"), keep=("id",), delay=delay))
        assert sorted(r.id for r in sinks.read_first(spark, str(tmp_path / name)).collect()) == want


def test_state_survives_a_kill_before_the_commit(spark, tmp_path):
    """A batch was written but the stream was killed before it said so: compaction leaves it alone, and its replay counts once."""
    _, log = event_log(spark, 300)
    log = with_time(log)
    stream, out, check = stream_of(spark, log, str(tmp_path / "in")), str(tmp_path / "state"), tmp_path / "c"
    jobs.finish(jobs.track_state(stream, out, str(check)))
    done = sorted(int(p.name) for p in (check / "commits").iterdir() if p.name.isdigit())
    last = done[-1]
    (check / "commits" / str(last)).unlink()
    (check / "commits" / f".{last}.crc").unlink(missing_ok=True)
    assert jobs.compact_state(spark, out, str(check)) == last - 1
    assert [(r.first, r.last) for r in jobs.state_store(spark, out).runs()] == [(0, last - 1), (last, last)]
    jobs.finish(jobs.track_state(stream, out, str(check)))   # starts with the batch that was not committed
    assert jobs.state_store(spark, out).runs()[-1].attempt == 1
    want = {r.job_id: (r.event_id, r.n_events) for r in H.current_state(log).collect()}
    assert {r.job_id: (r["last"].event_id, r.n_events) for r in jobs.read_state(spark, out).collect()} == want


def test_first_seen(spark, tmp_path):
    df = spark.range(200).select((F.col("id") % 3).cast("string").alias("content_hash"), F.timestamp_seconds(F.col("id")).alias("uploaded_at"))
    jobs.finish(jobs.first_seen(stream_of(spark, df, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"), delay="1 hour"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


UPLOAD = "document_id int, original_filename string, file_size bigint, content_type string, text string"


def uploads(spark):
    good = "Acme Trading\nInvoice #A-1\nDate: 1/2/2024\nTotal $12.00\n"
    return spark.createDataFrame([(i, f"invoice_{i}.pdf" if i % 5 else "../x.pdf", 0 if i % 7 == 0 else 100, None, good if i % 3 else "bill") for i in range(40)], UPLOAD)


def test_ingest_equals_batch(spark, tmp_path):
    columns = ["document_id", "document_type", "is_valid", "validation_score"]
    df = uploads(spark)
    jobs.finish(jobs.ingest(stream_of(spark, df, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c"), columns))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, jobs.document_flow(df).select(*columns).collect())) and len(got) > 10


def test_outbox_is_idempotent(spark, tmp_path):
    hooks = spark.createDataFrame([(1, "u1", True, ["document.processed"]), (2, "u2", True, None)], "webhook_id int, url string, active boolean, events array<string>")
    df = spark.createDataFrame([(i, "document.processed") for i in range(30)], "document_id int, event string")
    stream, out = stream_of(spark, df, str(tmp_path / "in")), str(tmp_path / "out")
    for checkpoint in ("c1", "c2"):   # the second run is a replay from the start
        jobs.finish(jobs.deliver(stream, hooks, out, str(tmp_path / checkpoint)))
        assert sinks.read_outbox(spark, out).count() == 60
    again = spark.createDataFrame([(5, "document.processed")], df.schema)   # a document seen before, in a later batch
    from papertrail.operators import webhooks as I
    sinks.append_outbox(I.outbox(I.match_subscriptions(again, hooks)), out, 99)
    assert sinks.read_outbox(spark, out).count() == 60


def test_file_stream(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    for i in range(3):
        (folder / f"f{i}.pdf").write_bytes(b"abc" * (i + 1))
    query = stream_files(spark, str(folder)).select("original_filename", "file_size").writeStream.format("parquet") \
        .option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    jobs.finish(query)
    assert sorted((r.original_filename, r.file_size) for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [("f0.pdf", 3), ("f1.pdf", 6), ("f2.pdf", 9)]


def test_many_keys_share_state(spark, tmp_path):
    """Thousands of jobs and windows are as many rows of state as there are buckets, over several batches."""
    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 1_000_000)
    status = F.when(F.col("id") % 3 > 0, "PENDING").otherwise("SUCCESS")
    log = spark.range(6000).select(F.col("id").alias("event_id"), (F.col("id") * 7 % 2000).alias("job_id"), at.alias("ts"), status.alias("task_status"))
    folder = tmp_path / "in"
    for k in range(2):
        log.filter((F.col("event_id") / 3000).cast("int") == k).coalesce(1).write.parquet(str(folder / f"p={k}"))
        in_turn(folder, k)
    stream = stream_table(spark, str(folder), log.schema, files_per_batch=1)
    query = jobs.stuck(stream, str(tmp_path / "stuck"), str(tmp_path / "c1"), buckets=5)
    jobs.finish(query)
    events = [tuple(r) for r in log.collect()]
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "stuck")).collect()) == stuck_ids(events)
    assert max(o.numRowsTotal for p in query.recentProgress for o in p.stateOperators) < 5 * 20
    query = jobs.admit_requests(stream, str(tmp_path / "admit"), str(tmp_path / "c2"), "job_id", "1 hour", 1, buckets=5)
    jobs.finish(query)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "admit")).select(*log.columns, "admitted").collect()))
    assert got == sorted(map(tuple, H.rate_admission(log, "job_id", "1 hour", 1).collect()))
    assert max(o.numRowsTotal for p in query.recentProgress for o in p.stateOperators) < 5 * 20


def test_ends_by_key():
    rng = random.Random(4)
    for _ in range(200):
        opens = [(rng.randrange(-1, 4), rng.randrange(60)) for _ in range(rng.randrange(20))]
        ends = [(rng.randrange(4), rng.randrange(60)) for _ in range(rng.randrange(20))]
        keys, since = (np.array([x[i] for x in opens], np.int64) for i in range(2))
        end_keys, times = (np.array([x[i] for x in ends], np.int64) for i in range(2))
        want = [any(k == key and t < at <= t + 9 for key, at in ends) for k, t in opens]
        assert ended_by_key(keys, since, end_keys, times, 9).tolist() == want
        assert ended_by_key(keys, since, *thinned_by_key(end_keys, times, 9), 9).tolist() == want
