"""Batch tables: whole batches only, replays, merges, searches that open few files."""

import datetime as dt

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from papertrail.sources import sinks
from papertrail.sources.store import BatchStore, Run, committed_batch, visible


def rows(spark, batch, n=20):
    return spark.range(n, numPartitions=1).select((F.col("id") + batch * n).alias("id"), F.lit(batch).alias("v"))


def ids(df):
    return sorted(r.id for r in df.collect())


def test_half_written_batches_are_not_seen(spark, tmp_path):
    store = BatchStore(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        store.read()
    store.write(rows(spark, 0), 0)
    rows(spark, 7).withColumn("_batch", F.lit(1)).write.parquet(str(tmp_path / "s" / "run=1-1.0"))   # killed before its commit
    assert ids(store.read()) == list(range(20))
    store.write(rows(spark, 1), 1)
    assert ids(store.read()) == list(range(40))


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    store = BatchStore(spark, str(tmp_path))
    for batch, n in ((0, 20), (1, 20), (1, 5)):
        store.write(rows(spark, batch, n), batch)
    assert len(ids(store.read())) == 25 and [r.name for r in store.runs()] == ["0-0.0", "1-1.1"]


def test_merges_keep_rows_and_bound_the_runs(spark, tmp_path):
    store = BatchStore(spark, str(tmp_path), fan=2, keep_seconds=0)
    for batch in range(9):
        store.write(rows(spark, batch, 3), batch)
        assert ids(store.read()) == sorted(i + b * 3 for b in range(batch + 1) for i in range(3))
    assert [(r.first, r.last) for r in store.runs()] == [(0, 7), (8, 8)]
    assert len(list(tmp_path.glob("run=*"))) == 2 and {r["_batch"] for r in store.read().collect()} == set(range(9))
    store.write(rows(spark, 3, 3), 3)   # a replay of a batch that has been merged
    assert len(ids(store.read())) == 27


def test_a_fold_is_applied_to_merged_runs(spark, tmp_path):
    store = BatchStore(spark, str(tmp_path), fold=lambda df: df.groupBy("id").agg(F.sum("v").alias("v"), F.max("_batch").alias("_batch")))
    for batch in range(5):
        store.write(spark.range(4).select("id", F.lit(1).cast("long").alias("v")), batch)
    store.compact(3)
    assert sorted((r.id, r.v) for r in store.read().collect()) == sorted([(i, 4) for i in range(4)] + [(i, 1) for i in range(4)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.booleans(), st.integers(0, 3)), max_size=60))
def test_visible_runs_are_disjoint_and_whole(steps):
    """Any order of writes, replays, merges and compactions shows every committed batch once."""
    runs, batches = [], set()
    for batch, whole, fan in steps:
        attempt = sum((r.first, r.last) == (batch, batch) for r in runs)
        runs.append(Run(batch, batch, attempt))
        batches.add(batch)
        inside = [r for r in visible(runs) if r.last < batch and (whole or r.first >= batch - 2 ** (fan + 1))]
        if len(inside) > 1:
            runs.append(Run(min(r.first for r in inside), max(r.last for r in inside), 0))
        shown = visible(runs)
        assert all(a.last < b.first for a, b in zip(shown, shown[1:]))
        assert all(any(r.first <= b <= r.last for r in shown) for b in batches)


def files_of(df):
    return {r.p for r in df.select(F.input_file_name().alias("p")).distinct().collect()}


def test_one_record_opens_one_bucket(spark, tmp_path):
    df = spark.range(400).select(F.col("id").alias("document_id"), F.lit("invoice").alias("document_type"))
    sinks.write_records(df, str(tmp_path), 0, buckets=8)
    sinks.write_records(df.filter("document_id < 50"), str(tmp_path), 1, buckets=99)   # the first batch's number holds
    for i in (3, 60, 399):
        found = sinks.read_record(spark, str(tmp_path), i)
        assert [(r.document_id, r["_batch"]) for r in found.collect()] == [(i, 1 if i < 50 else 0)]
        assert "PartitionFilters: [isnotnull(_bucket" in found._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert sinks.read_records(spark, str(tmp_path)).count() == 400
    assert len(list(tmp_path.glob("run=0-0.0/document_type=invoice/_bucket=*"))) == 8


def test_records_without_id_and_with_equal_ids_stay(spark, tmp_path):
    schema = "document_id long, document_type string, v int"
    sinks.write_records(spark.createDataFrame([(None, "a", 0), (1, "a", 0), (2, None, 0)], schema), str(tmp_path), 0)
    sinks.write_records(spark.createDataFrame([(None, "a", 1), (1, "b", 1), (1, "b", 2)], schema), str(tmp_path), 1)
    got = sorted(((r.document_id, r.document_type, r.v) for r in sinks.read_records(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(None, "a", 1), (1, "b", 1), (1, "b", 2), (2, None, 0)], key=str)


def deliveries(spark, month, first, n):
    return spark.range(first, first + n).select(F.concat(F.lit(f"{month}-"), F.col("id").cast("string")).alias("delivery_id"), F.lit(month).alias("month"))


def test_outbox_never_sends_twice_and_reads_its_own_period(spark, tmp_path):
    path, read = str(tmp_path), []
    for batch in range(10):
        month = 202001 + batch // 2   # two batches a month; the second repeats half of the first's
        sinks.append_outbox(deliveries(spark, month, 20 * (batch % 2), 40), path, batch, F.col("month"))
        stored = sinks.outbox_store(spark, path).read(before=batch + 1).filter(F.col("_period").isin(month))
        read.append(len(files_of(stored)))
    sent = [r.delivery_id for r in sinks.read_outbox(spark, path).collect()]
    assert len(sent) == len(set(sent)) == 5 * 60
    assert max(read) <= 2 * 2 * 16   # files of the batch's own month (two batches, two tasks, 16 buckets), however many months
    sinks.append_outbox(deliveries(spark, 202001, 0, 60), path, 10, F.col("month"))   # all of the first month again
    assert sinks.read_outbox(spark, path, 10).count() == 0


def test_the_plan_of_a_batch_opens_its_folders_only(spark, tmp_path):
    store = sinks.outbox_store(spark, str(tmp_path))
    for batch, month in enumerate((202001, 202002, 202003)):
        sinks.append_outbox(deliveries(spark, month, 0, 50), str(tmp_path), batch, F.col("month"))
    fresh = deliveries(spark, 202002, 40, 30).withColumns({"_period": F.lit(202002), "_bucket": F.lit(1)})
    plan = sinks._new(fresh, store, "delivery_id", 3, "_period", "_bucket")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    filters = [line for line in plan.splitlines() if line.startswith("PartitionFilters")]
    assert filters and all("202002" in f and "_bucket" in f for f in filters) and "ReadSchema: struct<delivery_id:string>" in plan


def test_first_rows_of_keys(spark, tmp_path):
    t = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    schema = "h string, at timestamp, id int"
    batches = [[("a", t(0), 1), ("a", t(0), 0), ("b", t(3), 2), (None, t(1), 3)], [("b", t(1), 4), ("c", t(2), 5)],
               [("a", t(40), 6), (None, t(41), 7), ("d", t(0), 8)]]
    for batch, some in enumerate([*batches, batches[1]]):
        sinks.append_first(spark.createDataFrame(some, schema), str(tmp_path), min(batch, 2) if batch < 3 else 1, "h", ("at", "id"))
    got = {(r.h, r.id) for r in sinks.read_first(spark, str(tmp_path)).collect()}
    assert got == {("a", 0), ("b", 2), (None, 3), ("c", 5), ("d", 8)}


def test_committed_batch(spark, tmp_path):
    assert committed_batch(spark, str(tmp_path)) == -1
    (tmp_path / "commits").mkdir()
    for name in ("0", "1", "10", ".2.crc", "3.tmp"):
        (tmp_path / "commits" / name).touch()
    assert committed_batch(spark, str(tmp_path)) == 10


def test_schema_may_grow(spark, tmp_path):
    store = BatchStore(spark, str(tmp_path))
    store.write(spark.range(2), 0)
    store.write(spark.range(2).withColumn("more", F.lit("x")), 1)
    assert sorted((r.id, r.more or "") for r in store.read().collect()) == [(0, ""), (0, "x"), (1, ""), (1, "x")]


def test_empty_batches(spark, tmp_path):
    store = BatchStore(spark, str(tmp_path), by=("k",), fan=2)
    for batch in range(5):
        store.write(spark.createDataFrame([], "id long, k int"), batch)
    assert store.read().count() == 0
    sinks.append_outbox(spark.createDataFrame([], "delivery_id string"), str(tmp_path / "o"), 0)
    sinks.append_outbox(spark.createDataFrame([], "delivery_id string"), str(tmp_path / "o"), 1)
    assert sinks.read_outbox(spark, str(tmp_path / "o")).count() == 0
