"""Streaming jobs over the same column expressions as the batch operators.

Each job takes a streaming DataFrame and returns a started query.  ``finish`` waits for a bounded
(``availableNow``) run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from papertrail import fixed_values as V
from papertrail.operators import admission as A, classify as C, extract as X, lifecycle as H, records as R
from papertrail.operators import validate as G, webhooks as I
from papertrail.sources.sinks import append_first, append_outbox
from papertrail.sources.store import BATCH, BatchStore, committed_batch
from papertrail.streaming.admit import Admission
from papertrail.streaming.overdue import Overdue

DEFAULT_DELAY = "10 minutes"
#: Keys of keyed state, over which the keys of the data are dealt by hash.  Fixed for the life of a checkpoint.
STATE_BUCKETS = 1024


def _start(df: DataFrame, checkpoint: str, mode: str, path: str | None = None,
           each: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if each is not None:
        return writer.foreachBatch(each).start()
    return writer.format("parquet").option("path", path).start()


def finish(query: StreamingQuery, seconds: int | None = None) -> None:
    """Wait for the end of a bounded run; with ``seconds``, stop and raise when it takes longer."""
    if seconds is None:
        query.awaitTermination()
    elif not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"stream still running after {seconds} s")
    if query.exception() is not None:
        raise query.exception()


def document_flow(uploads: DataFrame, threshold: float = X.DEFAULT_THRESHOLD, text: str = "text",
                  document_id: str = "document_id", strict: bool = True) -> DataFrame:
    """Admission, classification, extraction, record and verdict; works on batches and streams alike."""
    classified = C.classify(A.admitted(A.admit(uploads)))
    ready = classified.filter((A.extraction_gate(F.col("file_size")).isNull()) & (F.col(text) != ""))
    return G.validate(R.build_records(X.analyze(ready, threshold, text=text)), strict=strict,
                      document_id=document_id)


def failed_uploads(uploads: DataFrame, text: str = "text", document_id: str = "document_id") -> DataFrame:
    """The uploads that ``document_flow`` has no verdict for, with the stage that stopped them and why.

    Together the two have one row per upload; works on batches and streams alike.
    """
    judged = A.admit(uploads).withColumn("_gate", A.extraction_gate(F.col("file_size")))
    stage = F.when(F.col("reject_reason").isNotNull(), "classification").when(F.col("_gate").isNotNull(), "ocr") \
        .when(F.coalesce(F.col(text), F.lit("")) == "", "analysis")
    reason = F.coalesce("reject_reason", "_gate", F.lit("no text to analyze"))
    return judged.withColumns({"failed_stage": stage, "error": reason}).filter(F.col("failed_stage").isNotNull()) \
        .select(document_id, F.lit("failed").alias("stage"), "failed_stage", "error")


def quarantine(uploads: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """``failed_uploads`` of a stream to a table."""
    return _start(failed_uploads(uploads, **options), checkpoint, "append", path)


def ingest(uploads: DataFrame, path: str, checkpoint: str, columns: list[str],
           spread: tuple[int, str] | None = None, **options) -> StreamingQuery:
    """Uploads to checked records; stateless, so any number of executors and restarts.

    ``spread`` = (partitions, key) moves a micro-batch over more tasks than it has file splits, for
    sources of few large files.
    """
    if spread is not None:
        uploads = uploads.repartition(spread[0], spread[1])
    return _start(document_flow(uploads, **options).select(*columns), checkpoint, "append", path)


def first_seen(uploads: DataFrame, path: str, checkpoint: str, hash_col: str = "content_hash",
               time: str = "uploaded_at", delay: str = DEFAULT_DELAY, keep: tuple[str, ...] = ()) -> StreamingQuery:
    """One row per content hash within the watermark, with the columns ``keep`` of the first.

    State holds the hashes of the last ``delay`` and nothing else."""
    unique = uploads.select(hash_col, time, *keep).withWatermark(time, delay).dropDuplicatesWithinWatermark([hash_col])
    return _start(unique, checkpoint, "append", path)


def first_ever(uploads: DataFrame, path: str, checkpoint: str, hash_col: str = "content_hash", time: str = "uploaded_at",
               keep: tuple[str, ...] = (), delay: str | None = None) -> StreamingQuery:
    """One row per content hash for good, however much later a copy comes; ``sinks.read_first`` reads them.

    Every micro-batch is folded to its first row per hash and compared with the table of hashes seen, of which it opens the
    buckets it falls into.  No stream state is needed, and late rows count.  With ``delay``, a watermark takes copies within
    it out of the stream first, at the price of rows later than that.
    """
    rows = uploads.select(hash_col, time, *keep)
    if delay is not None:
        rows = rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([hash_col])

    def each(batch: DataFrame, batch_id: int) -> None:
        append_first(batch, path, batch_id, hash_col, (time, *keep))
    return _start(rows, checkpoint, "append", each=each)


STATE_COLUMNS = ("task_status", "stage")


def state_store(spark: SparkSession, path: str, key: str = "job_id") -> BatchStore:
    """Batches of states; merged runs hold one row per key, marked with the last batch that changed it."""
    def fold(rows: DataFrame) -> DataFrame:
        return rows.groupBy(key).agg(F.max("last").alias("last"), F.min("uploaded_at").alias("uploaded_at"),
                                     F.sum("n_events").alias("n_events"), F.max(BATCH).alias(BATCH))
    return BatchStore(spark, path, fold=fold)


def track_state(log: DataFrame, path: str, checkpoint: str, key: str = "job_id") -> StreamingQuery:
    """Running state: every micro-batch is folded to its last event per key and stored.

    No keyed state is held; ``read_state`` folds the stored rows, so late events lose by their order and a hot key is one
    row per batch.  The store merges committed batches as it goes, so what a reader folds does not grow with their number.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        folded = batch.groupBy(key).agg(
            F.max(F.struct(*H.ORDER, *STATE_COLUMNS)).alias("last"), F.min("ts").alias("uploaded_at"),
            F.count(F.lit(1)).alias("n_events"))
        state_store(batch.sparkSession, path, key).write(folded, batch_id)
    return _start(log, checkpoint, "append", each=each)


def read_state(spark: SparkSession, path: str, key: str = "job_id", ttl_seconds: int | None = None,
               as_of=None) -> DataFrame:
    """Current state from the committed batches; expired keys are left out when a TTL is given."""
    store = state_store(spark, path, key)
    state = store.fold(store.read()).drop(BATCH)
    if ttl_seconds is not None:
        state = state.filter(F.col("last.ts") > as_of - F.expr(f"INTERVAL {ttl_seconds} SECOND"))
    return state


def compact_state(spark: SparkSession, path: str, checkpoint: str, key: str = "job_id") -> int:
    """One row per key for all batches that the stream's checkpoint says are done; returns the last of them.

    A batch that was written but not committed by the stream stays apart, so its replay still replaces it.  Readers see the
    old runs or the new one, never both.
    """
    done = committed_batch(spark, checkpoint)
    state_store(spark, path, key).compact(done)
    return done


def stuck(log: DataFrame, path: str, checkpoint: str, key: str = "job_id",
          after_minutes: int = V.STUCK_AFTER_MINUTES, delay: str = DEFAULT_DELAY, buckets: int = STATE_BUCKETS) -> StreamingQuery:
    """PENDING events without a terminal event of the same key within ``after_minutes``, once the watermark has passed that.

    Keyed state with timers (``overdue.Overdue``): a bucket of keys holds their open PENDING events and a bounded number of
    terminal times of each.
    """
    kinds = dict(log.dtypes)
    status = F.col("task_status")
    events = log.filter(status.isin("PENDING", *H.TERMINAL)).withWatermark("ts", delay) \
        .select(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).alias("bucket"), F.col(key).cast("string").alias("name"),
                "ts", F.unix_micros("ts").alias("moment"), F.col("event_id").cast("string").alias("event_id"), (status == "PENDING").alias("opens"))
    late = events.groupBy("bucket").transformWithStateInPandas(
        Overdue(key, after_minutes), f"`{key}` string, event_id string, pending_since long", "append", "eventTime")
    found = late.select(F.col(key).cast(kinds[key]).alias(key), F.col("event_id").cast(kinds["event_id"]).alias("event_id"),
                        F.timestamp_micros("pending_since").alias("pending_since"))
    return _with_rocksdb(log, lambda: _start(found, checkpoint, "append", path))


def _with_rocksdb(df: DataFrame, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Timers and map state need this store; other streams of the session keep theirs."""
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(_STORE)
    conf.set(_STORE, _ROCKSDB)
    try:
        return start()
    finally:
        conf.set(_STORE, before)


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rate_windows(log: DataFrame, path: str, checkpoint: str, client: str, window: str, limit: int,
                 delay: str = DEFAULT_DELAY) -> StreamingQuery:
    """Closed tumbling windows with their request count and limit flag."""
    counted = log.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), client).agg(
        F.count(F.lit(1)).alias("n_requests"))
    return _start(counted.select(client, F.col("w.start").alias("window_start"), "n_requests",
                                 (F.col("n_requests") > limit).alias("exceeded")), checkpoint, "append", path)


def admit_requests(log: DataFrame, path: str, checkpoint: str, client: str, window: str, limit: int, event_id: str = "event_id",
                   delay: str = DEFAULT_DELAY, buckets: int = STATE_BUCKETS) -> StreamingQuery:
    """Every request with its answer ``admitted``, in the micro-batch it arrives in; windows need not be closed.

    On a log in order of time this is ``lifecycle.rate_admission``.  Requests later than the watermark get no answer; those
    without a time belong to no window.
    """
    schema = log.schema
    packed = log.withWatermark("ts", delay).select(F.col(client).cast("string").alias("client"), F.unix_millis(F.window("ts", window)["end"]).alias("until"), "ts",
                         F.unix_micros("ts").alias("moment"), F.coalesce(F.col(event_id).cast("long"), F.lit(-2**63)).alias("place"),
                         F.to_json(F.struct(*[F.col(f"`{c}`") for c in schema.names])).alias("row")) \
        .withColumn("bucket", F.pmod(F.xxhash64("client", "until"), F.lit(buckets)))
    answered = packed.groupBy("bucket").transformWithStateInPandas(
        Admission(limit), "row string, admitted boolean", "append", "eventTime")
    opened = answered.select(F.from_json("row", schema).alias("r"), "admitted").select("r.*", "admitted")
    return _with_rocksdb(log, lambda: _start(opened, checkpoint, "append", path))


def deliver(events: DataFrame, webhooks: DataFrame, path: str, checkpoint: str, document_id: str = "document_id",
            period: str | None = None) -> StreamingQuery:
    """Valid documents to the outbox; replays and repeated documents add nothing.

    ``period`` names a column of whole numbers that a document always brings along, such as its month (``append_outbox``).
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        matches = I.match_subscriptions(I.with_payload(batch, document_id), webhooks)
        rows = I.outbox(matches, document_id, carry=(period,) if period else ())
        append_outbox(rows, path, batch_id, F.col(period) if period else None)
    return _start(events, checkpoint, "append", each=each)
