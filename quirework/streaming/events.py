"""Structured Streaming twins of the queue, progress, payment and rate operators.

The rules know no event time, so late data is ours to define: a row older than the stated watermark is dropped; until
then every operator is idempotent. Operators with state of their own need the RocksDB state store provider.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.config import DEFAULTS, Settings
from quirework.operators import payments as PY
from quirework.operators.jobs import attempt_route
from quirework.streaming import state


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Zone-less timestamps cannot carry a watermark."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def first_completions(messages: DataFrame, keep: str = "7 days") -> DataFrame:
    """The first outcome row per (job, batch, outcome) within the marker's life time."""
    return messages.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["job_id", "batch_id", "outcome"])


def job_counters(outcomes: DataFrame, lateness: str = "7 days", keep_days: int = 7) -> DataFrame:
    """Running done/failed counts per job, and ``finalize`` when all are in; as a stream in update mode.

    A stream keeps the seen (batch, outcome) pairs and whether it has fired until the watermark is ``keep_days`` past the job's last
    outcome: one row per job and micro-batch, redelivered outcomes are not counted, and ``finalize`` is true in one row of a job
    only. A table is one batch: feed it ``first_per_key`` rows.
    """
    if outcomes.isStreaming:
        rows = outcomes.withWatermark("ts", lateness).select(
            "job_id", F.col("batch_id").cast("long").alias("batch_id"), "outcome", F.col("total").cast("int").alias("total"), "ts")
        return rows.groupBy("job_id").transformWithStateInPandas(state.Counters(keep_days), state.Counters.SCHEMA, "update", "EventTime")
    done, failed = F.count_if(F.col("outcome") == "ok").cast("int"), F.count_if(F.col("outcome") == "failed").cast("int")
    total = F.max("total")
    return outcomes.groupBy("job_id").agg(
        done.alias("done"), failed.alias("failed"), total.alias("total"), ((total > 0) & (done + failed >= total)).alias("finalize"))


def progress_state(updates: DataFrame, lateness: str = "2 days", keep_days: int = 2) -> DataFrame:
    """Monotone progress per job, one output row per update (batch twin: W7).

    Updates of a micro-batch are taken in the order of ts; a job's shown values leave when the watermark is ``keep_days`` past its last update.
    """
    rows = updates.withWatermark("ts", lateness).select("job_id", "event_id", "ts", F.col("pct").cast("int").alias("pct"), "stage")
    return rows.groupBy("job_id").transformWithStateInPandas(state.Progress(keep_days), state.Progress.SCHEMA, "append", "EventTime")


def subscription_changes(notices: DataFrame, profiles: DataFrame, lateness: str = "7 days", cfg: Settings = DEFAULTS) -> DataFrame:
    """T4: payment notices to subscription states, one row per subscription that a micro-batch changes (update mode).

    The first notice of a key counts; a key belongs to one subscription. The state after all notices is that of
    ``payments.subscription_states`` over them, in whatever batches they came, as long as none is later than ``lateness``. Profiles are the initial
    state, read when the query first starts; of several with one subscription id the smallest id owns it. Notices of unknown ids are passed over.
    """
    routed = PY.route(PY.parse_notices(event_time(notices, "received_at").withWatermark("received_at", lateness)))
    own = F.concat(F.lit("row:"), F.col("event_id").cast("string"))
    rows = routed.filter(F.col("action").isin("activate", "deactivate") & F.col("subscription_id").isNotNull()).select(
        "subscription_id", F.coalesce("dedup_key", own).alias("key"), F.unix_micros("received_at").alias("at_us"), "event_id", "action",
        PY.epoch_seconds(routed, "received_at").alias("at"), PY.epoch_seconds(routed, "period_end").alias("ends"),
        PY.epoch_seconds(routed, "period_start").alias("begins"), "received_at")
    return rows.groupBy("subscription_id").transformWithStateInPandas(
        state.Subscriptions(cfg), state.Subscriptions.SCHEMA, "update", "EventTime",
        initialState=PY.subscription_owners(profiles).groupBy("subscription_id"))


def requests_per_minute(requests: DataFrame, key: str = "user_id", limit: int = DEFAULTS.requests_per_minute,
                        lateness: str = "5 minutes") -> DataFrame:
    """T5: fixed one-minute counts per key and whether the limit is exceeded."""
    per = (requests.withWatermark("ts", lateness) if requests.isStreaming else requests).groupBy(F.window("ts", "1 minute"), key).agg(
        F.count(F.lit(1)).alias("requests")
    )
    return per.select(key, F.col("window.start").alias("minute"), "requests", (F.col("requests") > limit).alias("limited"))


def queue_waits(dequeues: DataFrame) -> DataFrame:
    """Seconds spent waiting in the queue, summed per job (update mode)."""
    wait = F.greatest(
        F.lit(0.0), F.col("dequeued_at").cast("double") - F.col("enqueued_at").cast("double")
    )
    return dequeues.groupBy("job_id").agg(
        F.sum(wait).alias("queue_wait_s"), F.count(F.lit(1)).alias("batches")
    )


def attempt_routes(failures: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """What happens to a failed chunk."""
    attempt: Column = F.coalesce(F.col("attempt"), F.lit(0))
    route = attempt_route(attempt, cfg)
    return failures.withColumns({"route": route, "next_attempt": F.when(route == "requeue", attempt + 1).otherwise(attempt)})
