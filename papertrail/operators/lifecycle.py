"""Lifecycle events to states, reports and queues.

Every fold is a ``max`` over a struct that starts with the event's order (ts, event_id): it combines on
the map side, so a job with a third of all events is reduced where it is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from papertrail import fixed_values as V

ORDER = ("ts", "event_id")
TERMINAL = ("SUCCESS", "FAILURE")


def _latest(*columns: str, when: Column | None = None) -> Column:
    value = F.struct(*ORDER, *[c for c in columns if c not in ORDER])
    return F.max(value if when is None else F.when(when, value))


def latest_time(log: DataFrame, plus_minutes: int = 1) -> Column:
    """A reference time from the log itself, as a scalar subquery."""
    return log.agg((F.max("ts") + F.expr(f"INTERVAL {plus_minutes} MINUTE")).alias("as_of")).scalar()


def public_status(task_status: Column) -> Column:
    result = F.lit("processing")
    for raw, shown in V.STATUS_MAP.items():
        result = F.when(task_status == raw, shown).otherwise(result)
    return result


def current_state(log: DataFrame, key: str = "job_id") -> DataFrame:
    """Last write per key, plus the first write's time."""
    return log.groupBy(key).agg(
        _latest("task_status", "stage").alias("last"), F.min("ts").alias("uploaded_at"),
        F.count(F.lit(1)).alias("n_events")) \
        .select(key, "uploaded_at", "n_events", F.col("last.event_id").alias("event_id"),
                F.col("last.ts").alias("updated_at"), F.col("last.task_status").alias("task_status"),
                F.col("last.stage").alias("stage"),
                public_status(F.col("last.task_status")).alias("status"))


def failure_state(log: DataFrame, error: str, key: str = "job_id") -> DataFrame:
    """Current status with the last failure's time and error."""
    return log.groupBy(key).agg(
        _latest("task_status").alias("last"),
        _latest(error, when=F.col("task_status") == "FAILURE").alias("failed"),
        F.count_if(F.col("task_status") == "FAILURE").alias("n_failures")) \
        .select(key, public_status(F.col("last.task_status")).alias("status"), "n_failures",
                F.col("failed.ts").alias("failed_at"), F.col(f"failed.{error}").alias("error"))


def live_keys(log: DataFrame, as_of: Column, key: str = "job_id",
              document_ttl: int = V.DOCUMENT_TTL_SECONDS, job_ttl: int = V.JOB_TTL_SECONDS) -> DataFrame:
    """Which entries have not expired, counted from the last write."""
    def alive(seconds: int) -> Column:
        return F.col("last_write") > as_of - F.expr(f"INTERVAL {seconds} SECOND")
    return log.groupBy(key).agg(F.max("ts").alias("last_write")).select(
        key, "last_write", alive(document_ttl).alias("document_live"), alive(job_ttl).alias("job_live"))


def metrics(state: DataFrame, webhooks: DataFrame, live_jobs: DataFrame) -> DataFrame:
    """One row of counters."""
    counts = state.agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.count_if(F.col("status") == "completed").alias("completed_documents"),
        F.count_if(F.col("status") == "failed").alias("failed_documents"))
    return counts.select(
        "*", (F.col("total_documents") - F.col("completed_documents") - F.col("failed_documents"))
        .alias("processing_documents"),
        webhooks.agg(F.count(F.lit(1)).alias("n")).scalar().alias("registered_webhooks"),
        live_jobs.agg(F.count(F.lit(1)).alias("n")).scalar().alias("active_jobs"))


def stage_metrics(log: DataFrame) -> DataFrame:
    """Average time of finished runs and success rate, per stage."""
    done = F.col("task_status").isin(*TERMINAL)
    return log.groupBy("stage").agg(
        F.count_if(done).alias("n_finished"),
        F.avg(F.when(done, F.col("duration_ms"))).alias("average_time_ms"),
        F.avg(F.when(done, (F.col("task_status") == "SUCCESS").cast("double"))).alias("success_rate"))


def stuck_tasks(state: DataFrame, as_of: Column, include_recovered: bool = False) -> DataFrame:
    """Tasks still PENDING (or recovered ones, on request) with the time since upload."""
    stuck = F.col("task_status") == "PENDING"
    if include_recovered and "auto_recovered" in state.columns:
        stuck = stuck | F.col("auto_recovered")
    return state.filter(stuck).withColumn(
        "stuck_seconds", F.timestamp_diff("SECOND", F.col("uploaded_at"), as_of))


def recovery_queue(state: DataFrame, as_of: Column, key: str = "job_id", suffix: Column | None = None,
                   after_minutes: int = V.STUCK_AFTER_MINUTES) -> DataFrame:
    """Requeue rows for tasks PENDING for longer than ``after_minutes``."""
    old = F.col("uploaded_at") < as_of - F.expr(f"INTERVAL {after_minutes} MINUTE")
    ending = F.lit(".pdf") if suffix is None else suffix
    return _requeue(state.filter((F.col("task_status") == "PENDING") & old), key, "auto_recovered") \
        .withColumn("file_path", F.concat(F.col(key).cast("string"), ending))


def retry_rows(state: DataFrame, ids: DataFrame, key: str = "job_id") -> DataFrame:
    """Requeue rows for the ids asked for, whatever their status."""
    return _requeue(state.join(ids.select(key).distinct(), key, "left_semi"), key, "manual_retry")


def _requeue(state: DataFrame, key: str, flag: str) -> DataFrame:
    return state.select(
        key, F.col("event_id").alias("old_task_id"),
        F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.col("event_id").cast("string"), F.lit(flag)), 256)
        .alias("new_task_id"),
        F.lit("processing").alias("status"), F.lit(True).alias(flag))


def attempt_fold(log: DataFrame, error: str, key: str = "job_id") -> DataFrame:
    """Attempts of each (job, stage) to one run: status, retry and error counts, duration, last error.

    A run without a successful attempt has failed once it reported so or used up its attempts.
    """
    status, limit = F.col("task_status"), F.lit(2)
    for stage, attempts in V.STAGE_ATTEMPTS.items():
        limit = F.when(F.col("stage") == stage, attempts).otherwise(limit)
    bad = status.isin("RETRY", "FAILURE")
    runs = log.groupBy(key, "stage").agg(
        F.count_if(status == "SUCCESS").alias("successes"), F.count_if(status == "FAILURE").alias("failures"),
        F.count_if(status == "STARTED").alias("starts"), F.count_if(status == "RETRY").alias("retry_count"),
        F.count_if(bad).alias("error_count"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
        _latest(error, when=bad).alias("_error"))
    folded = F.when(F.col("successes") > 0, "completed") \
        .when((F.col("failures") > 0) | (F.col("error_count") >= limit), "failed") \
        .when(F.col("error_count") > 0, "retrying").when(F.col("starts") > 0, "running").otherwise("pending")
    return runs.select(
        key, "stage", folded.alias("status"), "retry_count", "error_count", "start_time", "end_time",
        F.timestamp_diff("MILLISECOND", F.col("start_time"), F.col("end_time")).alias("duration_ms"),
        F.col(f"_error.{error}").alias("error"))


def fold_stage_runs(runs: DataFrame, key: str = "document_id") -> DataFrame:
    """Long stage runs (key, stage, status, error) to one row per key.

    The first failed stage in pipeline order stops the document.  Without one it is completed when every stage has
    completed; else its stage is the first that has not, whether it is under way, waiting or absent.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in V.STAGES]), F.col("stage"))
    first = F.min(F.when(F.col("status") == "failed", F.struct(place.alias("place"), "stage", "error")))
    done = [F.max(((F.col("stage") == s) & (F.col("status") == "completed")).cast("int")).alias(f"_{s}") for s in V.STAGES]
    open_ = F.coalesce(*[F.when(F.coalesce(f"_{s}", F.lit(0)) == 0, s) for s in V.STAGES])
    return runs.groupBy(key).agg(first.alias("f"), *done).select(
        key, F.when(F.col("f").isNotNull(), "failed").otherwise(F.coalesce(open_, F.lit("completed"))).alias("stage"),
        F.col("f.stage").alias("failed_stage"), _failure_text(F.col("f.stage"), F.col("f.error")).alias("error"))


def _failure_text(stage: Column, error: Column) -> Column:
    label = F.lit(None).cast("string")
    for name, shown in V.STAGE_LABELS.items():
        label = F.when(stage == name, shown).otherwise(label)
    return F.concat(label, F.lit(" failed: "), error)


def stage_outcomes(df: DataFrame, failures: dict[str, Column]) -> DataFrame:
    """Row-wise form of the stage fold: ``failures`` gives each stage's error or NULL.

    Adds stage, failed_stage, error and stages_run; later stages count as not run.
    """
    failed = F.lit(None).cast("string")
    error = F.lit(None).cast("string")
    run = F.lit(len(V.STAGES))
    for i, stage in reversed(list(enumerate(V.STAGES))):
        if stage in failures:
            hit = failures[stage].isNotNull()
            failed = F.when(hit, stage).otherwise(failed)
            error = F.when(hit, _failure_text(F.lit(stage), failures[stage])).otherwise(error)
            run = F.when(hit, i + 1).otherwise(run)
    return df.withColumns({"failed_stage": failed, "error": error, "stages_run": run}).withColumn(
        "stage", F.when(F.col("failed_stage").isNull(), "completed").otherwise("failed"))


def stage_pivot(log: DataFrame, key: str = "job_id") -> DataFrame:
    """Latest result per stage side by side; a failed one is NULL."""
    wide = log.groupBy(key).agg(*[
        _latest("task_status", when=F.col("stage") == s).alias(s) for s in V.STAGES])
    return wide.select(key, *[
        F.when(F.col(f"{s}.task_status") != "FAILURE", F.col(f"{s}.task_status")).alias(s) for s in V.STAGES])


def job_results(log: DataFrame, key: str = "job_id") -> DataFrame:
    """One stored result per finished job; the job state is set for completed ones only."""
    state = current_state(log, key)
    return state.filter(F.col("task_status").isin(*TERMINAL)).select(
        key, "status", "updated_at",
        F.when(F.col("status") == "completed", "completed").alias("job_state"))


def rate_windows(log: DataFrame, client: str, window: str, limit: int) -> DataFrame:
    """Requests per (client, window) and whether the limit is exceeded."""
    return log.groupBy(client, F.window("ts", window).alias("w")).agg(F.count(F.lit(1)).alias("n_requests")) \
        .select(client, F.col("w.start").alias("window_start"), "n_requests",
                (F.col("n_requests") > limit).alias("exceeded"))


def rate_admission(log: DataFrame, client: str, window: str, limit: int) -> DataFrame:
    """Adds ``admitted``: is the request among the window's first ``limit``?

    Only the first ``limit`` requests of a window are ranked (the rank filter is applied before the
    shuffle too); all rows are then compared with their window's last admitted one.
    """
    keyed = log.filter(F.col("ts").isNotNull()).withColumn("_start", F.window("ts", window)["start"])
    rank = F.row_number().over(Window.partitionBy(client, "_start").orderBy(*ORDER))
    cut = keyed.select(client, "_start", *ORDER).withColumn("_rank", rank).filter(F.col("_rank") <= limit) \
        .groupBy(client, "_start").agg(F.max(F.struct(*ORDER)).alias("_cut"))
    cut = cut.withColumnsRenamed({client: "_client", "_start": "_from"})
    judged = keyed.join(cut, F.col(client).eqNullSafe(F.col("_client")) & (F.col("_start") == F.col("_from"))) \
        .withColumn("admitted", F.struct(*ORDER) <= F.col("_cut")).select(*log.columns, "admitted")
    # A request without a time belongs to no window: its row stays, undecided.
    return judged.unionByName(log.filter(F.col("ts").isNull()).withColumn("admitted", F.lit(None).cast("boolean")))
