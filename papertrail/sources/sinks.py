"""Sinks: record tables, job results, security events, seen keys and the outbox.

All are ``store.BatchStore`` tables: a batch is seen whole or not at all, a replayed one replaces itself, and deliveries carry
a derived id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from papertrail.sources.store import BATCH, BUCKET, BatchStore, bucket

#: Folders that ids are dealt out to by their hash, in tables that are searched by id.
BUCKETS = 16
PERIOD = "_period"


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """The number of buckets goes with the column, so that readers find an id's bucket."""
    return df.withColumn(BUCKET, bucket(key, buckets)).withMetadata(BUCKET, {"buckets": buckets})


def _buckets(store: BatchStore, default: int) -> int:
    schema = store.schema()
    return schema[BUCKET].metadata["buckets"] if schema is not None else default


def write_records(df: DataFrame, path: str, batch_id: int = 0, fmt: str = "parquet", by: str = "document_type",
                  key: str = "document_id", buckets: int = BUCKETS) -> None:
    """Records by type and bucket of the id: a search by type or by id reads its folders alone.

    Earlier batches stay; the same batch written again replaces itself.  The number of buckets is that of the first batch.
    """
    store = BatchStore(df.sparkSession, path, (by, BUCKET), fmt=fmt)
    store.write(_bucketed(df, key, _buckets(store, buckets)), batch_id)


def read_records(spark: SparkSession, path: str, key: str = "document_id", fmt: str = "parquet") -> DataFrame:
    """The latest record of every document: of each id, the rows of its last committed batch.

    Ids and batches are compared apart from the records, which move only if very many ids have more than one.
    """
    stored = BatchStore(spark, path, fmt=fmt).read()
    latest = stored.groupBy(key).agg(F.max(BATCH).alias("_latest"), F.min(BATCH).alias("_first")) \
        .filter(F.col("_latest") > F.col("_first")).select(F.col(key).alias("_key"), "_latest")
    return stored.join(latest, F.col(key).eqNullSafe(F.col("_key")), "left") \
        .filter(F.col("_latest").isNull() | (F.col(BATCH) == F.col("_latest"))).select(*stored.columns)


def read_record(spark: SparkSession, path: str, document_id, key: str = "document_id", fmt: str = "parquet") -> DataFrame:
    """The latest record of one document, from the one bucket its id can be in."""
    store = BatchStore(spark, path, fmt=fmt)
    stored = store.read()
    wanted = F.lit(document_id).cast(stored.schema[key].dataType)
    here = F.pmod(F.xxhash64(wanted.cast("string")), F.lit(_buckets(store, BUCKETS))).cast("int")
    mine = stored.filter((F.col(BUCKET) == here) & (F.col(key) == wanted))
    return mine.filter(F.col(BATCH) == mine.agg(F.max(BATCH).alias("b")).scalar())


def write_results(path: str, batch_id: int, **tables: DataFrame) -> None:
    """Job results, job states, stage runs or other tables of one batch, each in a folder of its own name."""
    for name, df in tables.items():
        write_batch(df, f"{path}/{name}", batch_id)


def read_results(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """The named tables up to the last batch that all of them have."""
    stores = {name: BatchStore(spark, f"{path}/{name}") for name in names}
    done = min(max(store.batches(), default=-1) for store in stores.values())
    return {name: store.read(before=done + 1) for name, store in stores.items()}


def write_security_events(events: DataFrame, path: str, batch_id: int = 0, time: str = "uploaded_at") -> None:
    """Partitioned by date; a replayed batch replaces its own rows."""
    BatchStore(events.sparkSession, path, ("event_date",)).write(events.withColumn("event_date", F.to_date(time)), batch_id)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One micro-batch; a replay replaces it."""
    BatchStore(df.sparkSession, path).write(df, batch_id)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All rows of committed batches."""
    return BatchStore(spark, path).read()


def _new(rows: DataFrame, store: BatchStore, key: str, batch_id: int, *folders: str) -> DataFrame:
    """The rows whose key is in no earlier batch; only the folders that the rows fall into are opened.

    The stored keys are matched with the batch's (a semi join, whose small side is the batch), then the batch with what was
    found, so the store is not moved.
    """
    schema = store.schema()
    if schema is None:
        return rows
    # At most the number of folder values there are: buckets, and the periods of one batch.
    touched = rows.select(*folders).distinct().collect()
    stored = store.read(before=batch_id, schema=schema)
    for name in folders:
        stored = stored.filter(F.col(name).isin(sorted({r[name] for r in touched})))
    known = stored.select(key).join(rows.select(key), key, "left_semi").distinct()
    return rows.join(known, key, "left_anti")


def outbox_store(spark: SparkSession, path: str) -> BatchStore:
    return BatchStore(spark, path, (PERIOD, BUCKET), blooms=("delivery_id",))


def append_outbox(deliveries: DataFrame, path: str, batch_id: int, period: Column | None = None, buckets: int = BUCKETS) -> None:
    """Deliveries that no earlier batch has, as this batch's rows; a replayed batch writes the same rows again.

    ``period`` is a whole number that depends on the delivery alone, such as the month of the document's upload: a repeated
    delivery falls into the same one, so a batch is compared with the stored ids of its own periods and buckets and with
    nothing else, however long the history, and still nothing is sent twice.  Null is period 0.
    """
    store = outbox_store(deliveries.sparkSession, path)
    fresh = _bucketed(deliveries.withColumn(PERIOD, F.coalesce(period, F.lit(0)).cast("int") if period is not None else F.lit(0)),
                      "delivery_id", _buckets(store, buckets)).dropDuplicates(["delivery_id"]).persist()
    try:
        store.write(_new(fresh, store, "delivery_id", batch_id, PERIOD, BUCKET), batch_id)
    finally:
        fresh.unpersist()


def read_outbox(spark: SparkSession, path: str, batch_id: int | None = None) -> DataFrame:
    """All committed deliveries, or those a batch added."""
    stored = outbox_store(spark, path).read()
    return stored if batch_id is None else stored.filter(F.col(BATCH) == batch_id)


def append_first(rows: DataFrame, path: str, batch_id: int, key: str, order: tuple[str, ...], buckets: int = BUCKETS) -> None:
    """Of each key that no earlier batch has, the first row by ``order``.  A null key is a key.

    The keys seen so far are the table itself: dealt out to buckets, with a Bloom filter per file.
    """
    store = BatchStore(rows.sparkSession, path, (BUCKET,), blooms=(key,))
    rest = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_row")) \
        .select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])
    marked = _bucketed(first.withColumn("_known", F.coalesce(F.col(key).cast("string"), F.lit("\u0000"))), "_known",
                       _buckets(store, buckets)).persist()
    try:
        store.write(_new(marked, store, "_known", batch_id, BUCKET), batch_id)
    finally:
        marked.unpersist()


def read_first(spark: SparkSession, path: str) -> DataFrame:
    """The rows ``append_first`` has kept."""
    return BatchStore(spark, path).read().drop("_known", BUCKET, BATCH)


def send(deliveries: DataFrame, sender: Callable[[Row], tuple[int | None, str | None, int]]) -> DataFrame:
    """Calls the caller's ``sender(row) -> (status_code, transport_error, response_time_ms)`` for every
    delivery, inside the tasks, and returns the outcomes."""
    columns = deliveries.columns
    kinds = dict(deliveries.dtypes)

    def run(batches):
        import pandas as pd
        for batch in batches:
            out = []
            for values in batch.itertuples(index=False, name=None):
                try:
                    out.append(sender(Row(**dict(zip(columns, values)))))
                except Exception as error:
                    out.append((None, f"{type(error).__name__}: {error}", 0))
            yield pd.DataFrame({
                "delivery_id": batch["delivery_id"], "webhook_id": batch["webhook_id"],
                "status_code": pd.array([o[0] for o in out], dtype="Int32"),
                "transport_error": [o[1] for o in out],
                "response_time_ms": pd.array([o[2] for o in out], dtype="Int64")})
    return deliveries.mapInPandas(
        run, f"delivery_id {kinds['delivery_id']}, webhook_id {kinds['webhook_id']}, status_code int, "
             "transport_error string, response_time_ms bigint")
