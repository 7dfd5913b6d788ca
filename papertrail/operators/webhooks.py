"""Webhook registry, subscriptions, outbox and delivery reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from papertrail import fixed_values as V
from papertrail.functions.fence import fence


def registry(log: DataFrame, key: str = "webhook_id", columns: tuple[str, ...] = ("url", "active", "events"),
             defaults: dict[str, Column] | None = None) -> DataFrame:
    """Register/update/delete log to live rows, in one aggregation that combines on the map side.

    A row is live when its last register follows its last delete.  Each column holds its last supplied
    (non-null) value at or after that register, else its default.
    """
    op, seq = F.col("op"), F.col("seq")
    defaults = {"active": F.lit(True), "events": F.array(*[F.lit(e) for e in V.DEFAULT_EVENTS]),
                **(defaults or {})}
    folded = log.groupBy(key).agg(
        F.max(F.when(op == "register", seq)).alias("_registered"),
        F.max(F.when(op == "delete", seq)).alias("_deleted"),
        *[F.max(F.when(F.col(c).isNotNull() & (op != "delete"),
                       F.struct(seq.alias("seq"), F.col(c).alias("v")))).alias(f"_{c}") for c in columns])
    live = folded.filter(F.col("_registered") > F.coalesce("_deleted", F.lit(-1)))
    return live.select(key, *[
        F.coalesce(F.when(F.col(f"_{c}.seq") >= F.col("_registered"), F.col(f"_{c}.v")),
                   defaults.get(c, F.lit(None))).alias(c) for c in columns])


def active(webhooks: DataFrame) -> DataFrame:
    return webhooks.filter(F.coalesce("active", F.lit(False)))


def merge_registries(primary: DataFrame, legacy: DataFrame, key: str = "webhook_id") -> DataFrame:
    """All primary rows, plus legacy rows whose id the primary lacks."""
    only_old = legacy.join(primary.select(key), key, "left_anti")
    return primary.withColumn("store", F.lit("primary")).unionByName(
        only_old.withColumn("store", F.lit("legacy")))


def delivery_gate(validated: DataFrame) -> DataFrame:
    """Completed and valid documents, as ``document.processed`` events.

    A pipeline state counts where the rows carry one: ``stage`` must be ``completed`` then.
    """
    passed = F.col("is_valid")
    if "stage" in validated.columns:
        passed = passed & (F.col("stage") == "completed")
    return validated.filter(passed).withColumn("event", F.lit(V.PROCESSED_EVENT))


def _listed(webhooks: DataFrame) -> DataFrame:
    return active(webhooks).withColumn("events", F.coalesce("events", F.array(*[F.lit(e) for e in V.DEFAULT_EVENTS])))


def match_subscriptions(events: DataFrame, webhooks: DataFrame, key: str = "webhook_id") -> DataFrame:
    """One row per event and active webhook that subscribed to it: an equi-join on the event name.

    The registry is sized by the optimizer; what is too large to broadcast is joined by key, with hot names split.
    """
    routes = _listed(webhooks).select(key, "url", F.explode(F.array_distinct("events")).alias("event"))
    return events.join(routes, "event").withColumns(
        {"delivery_status": F.lit("eligible"), "reason": F.lit(None).cast("string")})


def skipped_subscriptions(events: DataFrame, webhooks: DataFrame, key: str = "webhook_id") -> DataFrame:
    """(event, webhook, n_events, reason) of active webhooks that did not subscribe to an event that occurred.

    Counts, not a row per document: event names are few, so they travel as one map.
    """
    seen = events.groupBy("event").agg(F.count(F.lit(1)).alias("n_events")) \
        .agg(F.collect_list(F.struct("event", "n_events")).alias("seen"))
    return _listed(webhooks).select(key, "events", F.explode(seen.scalar()).alias("e")) \
        .filter(~F.array_contains("events", F.col("e.event"))) \
        .select(F.col("e.event").alias("event"), key, F.col("e.n_events").alias("n_events"),
                F.lit("skipped").alias("delivery_status"), F.lit("event_not_subscribed").alias("reason"))


def with_payload(events: DataFrame, document_id: str = "document_id", schema: str | None = None,
                 as_of: Column | None = None) -> DataFrame:
    """Adds job_id and the JSON ``payload`` of each event, once per document, before any fan-out."""
    doc = F.col(document_id).cast("string")
    out = events.withColumn("job_id", F.sha2(F.concat_ws("|", F.lit("job"), doc), 256))
    payload = [F.col("event"), *([as_of.alias("timestamp")] if as_of is not None else []),
               doc.alias("document_id"), "job_id", *([F.parse_json(schema).alias("schema")] if schema else [])]
    return fence(out.withColumn("payload", F.to_json(F.struct(*payload))), "payload")


def outbox(matches: DataFrame, document_id: str = "document_id", key: str = "webhook_id",
           schema: str | None = None, as_of: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Deliveries to send: an idempotent id and the payload, for eligible matches, with the columns ``carry``.

    Matches of ``with_payload`` events carry theirs; others get it here.
    """
    doc = F.col(document_id).cast("string")
    matches = matches.filter(F.col("delivery_status") == "eligible")
    if "payload" not in matches.columns:
        matches = with_payload(matches, document_id, schema, as_of)
    return matches.select(
        F.sha2(F.concat_ws("|", doc, F.col(key).cast("string"), F.col("event")), 256).alias("delivery_id"),
        document_id, key, "url", "payload", *carry)


def outcome(status_code: Column, transport_error: Column) -> Column:
    return F.when(transport_error == "timeout", "timeout").when(transport_error.isNotNull(), "error") \
        .when(status_code.between(200, 299), "success").otherwise("failed")


#: Retries after a first attempt that failed, and the seconds before the first of them.
MAX_RETRIES, RETRY_SECONDS = 3, 30


def delivery_ledger(deliveries: DataFrame, attempts: DataFrame, as_of: Column, max_retries: int = MAX_RETRIES,
                    delay_seconds: float = RETRY_SECONDS, growth: float = 1.0, key: str = "delivery_id") -> DataFrame:
    """Where every delivery of the outbox stands after its attempts (``key``, attempted_at, delivery_status).

    Adds n_attempts, last_status, next_attempt_at and ``ledger``: ``new``, ``delivered`` (an attempt succeeded), ``exhausted`` (the
    first attempt and all retries failed), ``waiting`` or ``due``.  The wait after the n-th attempt is ``delay_seconds`` times
    ``growth`` to the power n - 1.  Attempts are folded on the map side first, so a delivery tried over and over is one row per
    task; of attempts at one moment a success counts, then the largest status.  Attempts without a time count, but set no wait.
    """
    status = F.col("delivery_status")
    folded = attempts.filter(status != "skipped").groupBy(F.col(key).alias("_key")).agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.struct("attempted_at", (status == "success").alias("ok"), status.alias("status"))).alias("_last"),
        F.max(status == "success").alias("_ok"))
    wait = F.make_dt_interval(secs=(F.lit(float(delay_seconds)) * F.pow(F.lit(float(growth)), F.col("_n") - 1)).cast("decimal(18,6)"))
    again = F.when(~F.col("_ok") & (F.col("_n") <= max_retries), F.coalesce(F.col("_last.attempted_at") + wait, as_of))
    n = F.coalesce("_n", F.lit(0))
    ledger = F.when(n == 0, "new").when(F.col("_ok"), "delivered").when(again.isNull(), "exhausted") \
        .when(again > as_of, "waiting").otherwise("due")
    return deliveries.join(folded, F.col(key) == F.col("_key"), "left").select(
        *deliveries.columns, n.alias("n_attempts"), F.col("_last.status").alias("last_status"), again.alias("next_attempt_at"),
        ledger.alias("ledger"))


def due_deliveries(ledger: DataFrame) -> DataFrame:
    """What a sender takes next: new deliveries and those whose wait is over."""
    return ledger.filter(F.col("ledger").isin("new", "due"))


def delivery_rollup(deliveries: DataFrame, *keys: str) -> DataFrame:
    """Counts and the wall time of parallel calls (their maximum) per key."""
    status = F.col("delivery_status")
    return deliveries.groupBy(*keys).agg(
        F.count_if(status == "success").alias("webhooks_triggered"),
        F.count_if(~status.isin("success", "skipped")).alias("webhooks_failed"),
        F.count_if(status == "skipped").alias("webhooks_skipped"),
        F.max("response_time_ms").alias("total_time_ms"))


#: Leading characters of a delivery id that part a key's report; ids are hashes, so 3 make up to 4096 even parts.
PART_CHARS = 3


def delivery_details(deliveries: DataFrame, *keys: str, order: str = "delivery_id", part: Column | None = None) -> DataFrame:
    """The details list in long form: ``position`` of each delivery within its key's report, from 0.

    Stays long on purpose: a report may have any number of deliveries.  A key's rows are numbered in parts, and a part starts
    where the counts of the parts before it end, so a key with most of all rows is many tasks.  ``part`` must not fall as
    ``order`` rises (null as ``order`` is null); by default the first characters of its text, so for an ``order`` other than
    text give one.
    """
    if part is None:
        if deliveries.schema[order].dataType.typeName() != "string":
            raise ValueError(f"{order} is no text: give the part that rises with it")
        part = F.substring(order, 1, PART_CHARS)
    rows = deliveries.select(*keys, order, *[c for c in ("webhook_id",) if c not in keys], "delivery_status",
                             "status_code", "response_time_ms")
    parted = rows.withColumn("_part", part)
    place = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(order)) - 1
    # One row per key and part, counted on the map side.
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parted.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n")) \
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    numbered, starts = parted.withColumn("_place", place).alias("r"), starts.alias("s")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*keys, "_part")]
    return numbered.join(starts, same).select(*[F.col(f"r.{c}") for c in rows.columns],
                                              (F.col("s._start") + F.col("r._place")).alias("position"))
