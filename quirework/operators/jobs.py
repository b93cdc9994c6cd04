"""Job, queue, request and stage statistics, quotas and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.config import DEFAULTS, Settings
from quirework.functions.clean import minor_units
from quirework.functions.text import is_retryable


def job_metrics(jobs: DataFrame) -> DataFrame:
    """A4: processed, failed, success rate (1.0 when none), mean seconds, tokens."""
    ok, bad = F.col("status") == "completed", F.col("status") == "failed"
    agg = jobs.agg(
        F.count_if(ok).alias("jobs_processed"),
        F.count_if(bad).alias("jobs_failed"),
        F.coalesce(F.sum(F.when(ok, F.col("processing_seconds"))), F.lit(0.0)).alias("_sec"),
        F.coalesce(F.sum(F.when(ok, F.greatest(F.col("tokens_used"), F.lit(0)))), F.lit(0)).alias("total_tokens"),
    )
    n, tries = F.col("jobs_processed"), F.col("jobs_processed") + F.col("jobs_failed")
    return agg.select(
        "jobs_processed", "jobs_failed", "total_tokens",
        F.when(tries > 0, F.bround(n / tries, 4)).otherwise(F.lit(1.0)).alias("success_rate"),
        F.when(n > 0, F.bround(F.col("_sec") / n, 3)).otherwise(F.lit(0.0)).alias("avg_processing_seconds"),
    )


#: Relative rank error of the sketches that bracket a percentile, and the ranks on each side that a bracket takes in (of all).
_SKETCH, _MARGIN = 10_000, 1e-3


def _brackets(value: Column, probs: list[float]) -> list[Column]:
    """Aggregates of one pass: how many values, and two values around each percentile from a mergeable sketch."""
    marks = [m for p in probs for m in (max(0.0, p - _MARGIN), min(1.0, p + _MARGIN))]
    return [F.count(value).alias("_n"), F.percentile_approx(value, marks, _SKETCH).alias("_marks")]


def _selected(rows: DataFrame, heads: DataFrame, key: str, value: Column, probs: list[float]) -> DataFrame:
    """(key, p, value): the exact percentiles, given ``_brackets`` per key.

    What lies below a bracket is one count, formed where the rows are; inside, a few thousandths of the
    rows, equal values are counted and ordered. A key with so few values that a bracket is no two ranks wide is ordered whole.
    """
    few = F.col("_n") * _MARGIN < 2
    at = lambda i: F.when(~few, F.get("_marks", F.lit(i)))
    spans = F.array(*[F.struct(F.lit(float(p)).alias("p"), at(2 * i).alias("lo"), at(2 * i + 1).alias("hi")) for i, p in enumerate(probs)])
    met = rows.select(key, value.alias("_v")).filter("_v IS NOT NULL").join(heads.select(key, "_n", spans.alias("_s")), key)
    met = met.select(key, "_n", "_v", F.explode("_s").alias("_s")).filter(F.col("_s.hi").isNull() | (F.col("_v") <= F.col("_s.hi")))
    inside = F.col("_s.lo").isNull() | (F.col("_v") >= F.col("_s.lo"))
    counts = met.groupBy(key, F.col("_s.p").alias("p"), "_n", F.when(inside, F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(key, "p").orderBy(F.asc_nulls_first("_v")))
    place = (F.col("_n") - 1) * F.col("p")
    ranked = counts.withColumns({"_upto": upto, "_place": place})
    held = lambda rank: F.max(F.when((F.col("_upto") - F.col("_k") <= rank) & (rank < F.col("_upto")), F.col("_v")))
    low, high = held(F.floor("_place")), held(F.ceil("_place"))
    frac = F.first("_place") - F.floor(F.first("_place"))
    return ranked.groupBy(key, "p").agg((low + (high - low) * frac).alias("value"))


def exact_percentiles(df: DataFrame, key: str, value: str, probs: list[float]) -> DataFrame:
    """Exact percentiles by linear interpolation in two passes, without sorting a key in one task."""
    v = F.col(value)
    return _selected(df, df.groupBy(key).agg(*_brackets(v, probs)), key, v, probs)


def latency_summary(requests: DataFrame, key: str = "level") -> DataFrame:
    """A5: latency of successful requests, error rate and throughput per level."""
    probs = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    good = F.when(F.col("ok"), F.col("elapsed_s"))
    totals = requests.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("ok").alias("success"),
        F.round(F.avg(good), 6).alias("avg"),
        F.min(good).alias("min"),
        F.max(good).alias("max"),
        F.sum("elapsed_s").alias("_wall"),
        F.count_if(~F.col("ok") & is_retryable(F.col("status"))).alias("retryable"),
        *_brackets(good, list(probs.values())),
    )
    marks = _selected(requests, totals, key, good, list(probs.values())).groupBy(key).agg(
        *[F.max(F.when(F.col("p") == p, F.round("value", 6))).alias(n) for n, p in probs.items()])
    return totals.join(marks, key, "left").select(
        key, "total", "success", "retryable", "avg", "min", "max", *probs,
        F.round(1 - F.col("success") / F.col("total"), 6).alias("error_rate"),
        F.when(F.col("_wall") > 0, F.round(F.col("success") / F.col("_wall"), 4)).otherwise(0.0)
        .alias("throughput"),
    )


def slow_levels(summary: DataFrame, limit: float = 3.0) -> DataFrame:
    """Levels whose p99 exceeds the limit."""
    return summary.filter(F.col("p99") > limit)


def slow_requests(requests: DataFrame, threshold: float = DEFAULTS.slow_request_seconds) -> DataFrame:
    """W12; a threshold of 0 switches the selection off."""
    return requests.filter(F.lit(threshold > 0) & (F.col("elapsed_s") >= threshold))


# stage totals that overlap in real time (fixed values)
_PARALLEL_STAGES = ("translation_api_per_batch_wall_sum_s",)


def _is_parallel(stage: Column) -> Column:
    return stage.isin(*_PARALLEL_STAGES) | (stage.startswith("chunk_") & stage.contains("_sum_s"))


def _long_rows(stages: DataFrame) -> DataFrame:
    """(job_id, stage, seconds, parallel, _denom, _rank), summed by job and stage and ranked in a window."""
    flat = stages.select("job_id", "e2e_wall_s", F.explode("stages").alias("stage", "s"))
    summed = flat.groupBy("job_id", "stage").agg(
        F.sum("s").alias("seconds"), F.max("e2e_wall_s").alias("e2e")
    )
    job = Window.partitionBy("job_id")
    own = summed.withColumn("parallel", _is_parallel(F.col("stage")))
    wall = F.sum(F.when(~F.col("parallel"), F.col("seconds"))).over(job)
    return own.withColumns({
        "_denom": F.when(F.col("e2e") > 0, F.col("e2e")).otherwise(wall),
        "_rank": F.row_number().over(job.orderBy("parallel", F.desc("seconds"), "stage")),
    })


def _wide_rows(stages: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """What ``_long_rows`` gives, from one row of sums per job: only these are shuffled, once, and a job's stages are ranked in its row."""
    each = {f"s{i}": name for i, name in enumerate(names)}
    flat = stages.select("job_id", "e2e_wall_s", *[F.col("stages")[name].alias(c) for c, name in each.items()])
    wide = flat.groupBy("job_id").agg(F.max("e2e_wall_s").alias("e2e"), *[F.sum(c).alias(c) for c in each])
    nothing = F.lit(0.0)
    wall = sum((F.when(~_is_parallel(F.lit(name)), F.coalesce(c, nothing)).otherwise(nothing) for c, name in each.items()), nothing)
    # In the order of the window: largest seconds first, not-a-number before all, null after all.
    rows = F.sort_array(F.array(*[F.struct(
        _is_parallel(F.lit(name)).alias("parallel"), F.col(c).isNull().alias("none"), (~F.isnan(c)).alias("number"), (-F.col(c)).alias("down"),
        F.lit(name).alias("stage"), F.col(c).alias("seconds")) for c, name in each.items()]))
    ranked = wide.select("job_id", F.when(F.col("e2e") > 0, F.col("e2e")).otherwise(wall).alias("_denom"), F.posexplode(rows).alias("_at", "_row"))
    return ranked.select("job_id", "_row.stage", "_row.seconds", "_row.parallel", "_denom", (F.col("_at") + 1).alias("_rank"))


def stage_report(stages: DataFrame, top: int = 2, digits: int = 2, names: tuple[str, ...] = ()) -> DataFrame:
    """Seconds and share of wall time per (job, stage); ``rank`` marks the bottlenecks.

    ``names`` are the stages where every row has the same ones; without them each row of a map is shuffled by job and stage, and again by job.
    """
    ranked = _wide_rows(stages, names) if names else _long_rows(stages)
    pct = F.when(F.col("_denom") > 0, 100.0 * F.col("seconds") / F.col("_denom")).otherwise(0.0)
    return ranked.select(
        "job_id", "stage", "parallel", F.round("seconds", 4).alias("seconds"),
        F.when(~F.col("parallel"), F.round(pct, digits)).alias("pct"),
        F.when(~F.col("parallel") & (F.col("_rank") <= top), F.col("_rank")).alias("rank"),
    )


def parallelism(rows: DataFrame) -> DataFrame:
    """Overlap ratio and note, and the average queue wait."""
    ratio = F.when(F.col("wall_s") > 0, F.col("api_sum_s") / F.col("wall_s"))
    return rows.withColumn("ratio", ratio).withColumns({
        "note": F.when(F.col("ratio").isNull(), F.lit(None)).when(F.col("ratio") <= 1.01, "serial")
        .otherwise("overlapping"),
        "avg_queue_wait_s": F.when(F.col("batches") > 0, F.col("queue_wait_sum_s") / F.col("batches")),
    })


def tokens_last_days(usage: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Tokens per user in the days before ``as_of``."""
    since = as_of - F.make_dt_interval(days=F.lit(days))
    return usage.filter((F.col("created_at") >= since) & (F.col("created_at") <= as_of)).groupBy("user_id").agg(
        F.sum("tokens_used").alias("tokens")
    )


def rolling_daily_tokens(usage: DataFrame, days: int = 30) -> DataFrame:
    """A13 for every day: usage collapses to (user, day) before the range window."""
    daily = usage.groupBy("user_id", F.to_date("created_at").alias("day")).agg(F.sum("tokens_used").alias("tokens"))
    n = F.datediff("day", F.lit("1970-01-01"))
    back = Window.partitionBy("user_id").orderBy("_n").rangeBetween(-days, 0)
    return daily.withColumn("_n", n).withColumn("rolling_tokens", F.sum("tokens").over(back)).drop("_n")


def chunk_counters(outcomes: DataFrame, totals: DataFrame) -> DataFrame:
    """done/failed batches per job (each batch counted once per outcome) and progress."""
    once = outcomes.select("job_id", "batch_id", "outcome").distinct()
    agg = once.groupBy("job_id").agg(
        F.count_if(F.col("outcome") == "ok").alias("done"), F.count_if(F.col("outcome") == "failed").alias("failed")
    )
    joined = totals.join(agg, "job_id", "left").na.fill(0, ["done", "failed"])
    total, done = F.col("total"), F.col("done")
    terminal = (total > 0) & (done + F.col("failed") >= total)
    safe = F.greatest(total, F.lit(1))
    return joined.withColumn("terminal", terminal).withColumns({
        "progress": F.when(F.col("terminal"), 88).otherwise(
            F.least(F.lit(88), F.floor(done * 65 / safe) + 23)).cast("int"),
        "progress_inline": F.least(F.lit(88), F.greatest(F.lit(23), F.floor(done * 66 / safe) + 22)).cast("int"),
    })


def queue_depths(messages: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Depth per queue and whether it is at capacity."""
    limit = F.when(F.col("queue") == "chunks", cfg.chunk_queue_max_messages).otherwise(cfg.max_queue_depth)
    return messages.groupBy("queue").agg(F.count(F.lit(1)).alias("depth")).withColumn(
        "at_capacity", F.col("depth") >= limit
    )


def queue_of_plan(plan: Column) -> Column:
    """W13."""
    return F.when(F.lower(F.coalesce(plan, F.lit(""))).isin("paid", "monthly", "yearly"), "high").otherwise("default")


def first_per_day(rows: DataFrame, at: str, order: list[str], limit: Column | int) -> DataFrame:
    """The rows admitted under a limit per user and UTC day.

    Spark turns a ranking filter into a per-partition limit before the shuffle, so a
    busy user sends only the rows that can still be admitted.
    """
    day = F.to_date(at)
    nth = F.row_number().over(Window.partitionBy("user_id", "_day").orderBy(*order))
    return rows.withColumn("_day", day).withColumn("nth", nth).filter(F.col("nth") <= limit).drop("_day")


def daily_job_quota(jobs: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Jobs within the daily limit of their plan (the paid limit bounds the ranking)."""
    limit = F.when(queue_of_plan(F.col("plan")) == "high", cfg.daily_jobs_paid).otherwise(cfg.daily_jobs_free)
    ranked = first_per_day(jobs, "created_at", ["created_at", "id"], max(cfg.daily_jobs_free, cfg.daily_jobs_paid))
    return ranked.filter(F.col("nth") <= limit)


def completed_page(jobs: DataFrame, page: int, page_size: int) -> DataFrame:
    """One page of every user's finished jobs, newest first, with the total."""
    done = jobs.filter((F.col("status") == "completed") | F.col("completed_at").isNotNull())
    total = done.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    skip = (page - 1) * page_size
    shown = done.withColumn("nth", F.row_number().over(newest)).filter(
        (F.col("nth") <= skip + page_size)
    ).filter(F.col("nth") > skip)
    return shown.join(total, "user_id")


def latest_jobs(jobs: DataFrame, k: int = 500) -> DataFrame:
    """W6."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    return jobs.withColumn("nth", F.row_number().over(newest)).filter(F.col("nth") <= k)


def monotone_progress(updates: DataFrame, chunk: str = "date_trunc('HOUR', ts)") -> DataFrame:
    """Percentages never fall within a job; only "failed at 0" resets them.

    The stage shown is the one of the latest update that reached the maximum. An hour
    of a job hands on one row: its best update since its last reset, later ones winning
    ties; the latest reset and then the best of those rows is the state before an hour.
    """
    new = F.greatest(F.lit(0), F.least(F.lit(100), F.col("pct")))
    parts = ["job_id", "_chunk"]
    hour = Window.partitionBy(*parts).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = updates.withColumns({"_new": new, "_chunk": F.expr(chunk)}).withColumn(
        "_epoch", F.sum(((F.col("stage") == "failed") & (F.col("_new") == 0)).cast("long")).over(hour)
    )
    best = F.max(F.struct("_epoch", "_new", "ts", "event_id", "stage")).alias("_best")
    hours = Window.partitionBy("job_id").orderBy("_chunk")
    handed = (
        rows.groupBy(*parts).agg(best)
        .withColumn("_resets", F.sum((F.col("_best._epoch") > 0).cast("long")).over(hours))
        .withColumn("_prev", F.max(F.struct("_resets", "_best._new", "_chunk", "_best.stage")).over(
            hours.rowsBetween(Window.unboundedPreceding, -1)))
        .select(*parts, F.col("_prev._new").alias("_pct0"), F.col("_prev.stage").alias("_stage0"))
    )
    top = F.max(F.struct("_epoch", "_new")).over(hour)["_new"]
    joined = rows.withColumn("_top", top).join(handed, parts)
    carried = F.when(F.col("_epoch") == 0, F.col("_pct0"))
    joined = joined.withColumn("progress", F.greatest("_top", carried))
    reached = F.when(F.col("_new") >= F.col("progress"), F.col("stage"))
    return joined.withColumn(
        "shown_stage", F.coalesce(F.last(reached, ignorenulls=True).over(hour), F.col("_stage0"))
    ).drop("_new", "_chunk", "_epoch", "_top", "_pct0", "_stage0")


def retry_accounting(jobs: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """What a failing attempt does to its job."""
    nxt = F.coalesce(F.col("translation_attempt"), F.lit(0)) + 1
    again = nxt < max(1, cfg.max_processing_attempts)
    return jobs.withColumns({
        "next_attempt": F.when(again, nxt).otherwise(F.coalesce(F.col("translation_attempt"), F.lit(0))),
        "next_status": F.when(again, "pending").otherwise("failed"),
    })


def expired_jobs(jobs: DataFrame, now: Column, cfg: Settings = DEFAULTS) -> DataFrame:
    """Completed longer ago than the clean-up time."""
    cutoff = now - F.make_dt_interval(mins=F.lit(cfg.cleanup_ttl_minutes))
    return jobs.filter((F.col("status") == "completed") & (F.col("completed_at") < cutoff))


def attempt_route(attempt: Column, cfg: Settings = DEFAULTS) -> Column:
    """Failing chunk goes back to the queue until its attempts are used up."""
    return F.when(attempt < cfg.chunk_task_max_retries, "requeue").otherwise("failed")


def job_list(jobs: DataFrame) -> DataFrame:
    """listing projection."""
    return jobs.select("id", "status", "created_at", "completed_at", minor_units(F.col("cost")).alias("amount_minor"))


def overlay_live(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Live rows win over stored ones with the same id."""
    cols = [c for c in stored.columns if c != "id"]
    s, v = stored.alias("s"), live.alias("v")
    return s.join(v, F.col("s.id") == F.col("v.id"), "full").select(
        F.coalesce("v.id", "s.id").alias("id"),
        *[F.when(F.col("v.id").isNotNull(), F.col(f"v.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in cols],
    )


def latest_progress(updates: DataFrame) -> DataFrame:
    newest = F.struct("ts", "event_id")
    return updates.groupBy("job_id").agg(
        F.max_by("pct", newest).alias("pct"), F.max_by("stage", newest).alias("stage")
    )


def job_details(jobs: DataFrame, progress: DataFrame) -> DataFrame:
    """Percent and stage per job; live progress counts only while processing."""
    st = F.lower(F.trim("status"))
    joined = jobs.join(latest_progress(progress).withColumnRenamed("job_id", "id"), "id", "left")
    processing = st == "processing"
    percent = (
        F.when(st.isin("completed", "preview_ready"), 100).when(st == "failed", 0)
        .when(processing, F.coalesce("pct", F.lit(12))).otherwise(10)
    )
    return joined.select(
        "id", st.alias("status"),
        F.greatest(F.lit(0), F.least(F.lit(100), percent)).alias("progress_percent"),
        F.when(st.isin("completed", "preview_ready", "failed"), F.lit(None))
        .when(processing, F.coalesce("stage", F.lit("preparing"))).otherwise("queued").alias("current_stage"),
        F.greatest(F.coalesce("tokens_used", F.lit(0)), F.lit(0)).alias("word_count"),
    )
