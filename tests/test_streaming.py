from __future__ import annotations

import datetime as dt

import pytest
from conftest import SF_DIR
from pyspark.sql import Window
from pyspark.sql import functions as F

from quirework.operators import jobs as J
from quirework.operators import payments as PY
from quirework.sources import tables
from quirework.streaming import events as ST


def _stream(spark, df, tmp_path, files: int = 3):
    """The rows of a table as a file stream, in several files, one per micro-batch."""
    path = str(tmp_path / "in")
    for i in range(files):
        df.filter(F.col("event_id") % files == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(stream, name, tmp_path, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option(
        "checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    return stream.sparkSession.table(name)


def _events(spark):
    return ST.event_time(tables.table(spark, SF_DIR, "events"))


@pytest.fixture(autouse=True)
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def _outcomes(spark):
    return _events(spark).select(
        "event_id", "ts", F.concat(F.lit("j"), (F.col("event_id") % 40).cast("string")).alias("job_id"),
        (F.col("user_id") % 6).cast("int").alias("batch_id"), F.when(F.col("user_id") % 6 == 0, "failed").otherwise("ok").alias("outcome"),
        F.lit(5).alias("total"))


def test_first_completions_and_counters(spark, tmp_path):
    """Counters equal the batch twin although every outcome comes many times, and the trigger fires once."""
    e = _outcomes(spark)
    once = _run(ST.first_completions(_stream(spark, e, tmp_path), "60 days"), "once", tmp_path)
    distinct = e.select("job_id", "batch_id", "outcome").distinct()
    assert once.count() == distinct.count()
    counted = _run(ST.job_counters(_stream(spark, e, tmp_path / "b"), "60 days"), "counted", tmp_path, "update")
    last = counted.groupBy("job_id").agg(F.max("done").alias("done"), F.max("failed").alias("failed"), F.sum(F.col("finalize").cast("long")).alias("fired"))
    twin = J.chunk_counters(distinct, e.select("job_id", F.lit(5).alias("total")).distinct())
    want = twin.select("job_id", "done", "failed", F.col("terminal").cast("long").alias("fired"))
    assert last.exceptAll(want).count() == 0 and want.exceptAll(last).count() == 0
    assert want.filter("fired = 1").count() > 0


def test_trigger_fires_once_over_restarts_and_late_outcomes(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    shape = "job_id string, batch_id int, outcome string, total int, ts timestamp"
    batches = [
        [("a", 0, "ok", 2), ("a", 0, "ok", 2), ("b", 0, "failed", 1)], [("a", 1, "ok", 2), ("b", 0, "failed", 1)],
        [("a", 1, "ok", 2), ("a", 1, "failed", 2), ("b", 7, "ok", 1)], [("c", 0, "ok", 0), ("c", 1, "ok", 3)], [("c", 2, "ok", 3), ("c", 3, "ok", 3)]]
    for n, rows in enumerate(batches):  # the query is started anew for each batch
        spark.createDataFrame([(*r, dt.datetime(2024, 1, 1 + n)) for r in rows], shape).coalesce(1).write.mode("append").parquet(path)
        told = ST.job_counters(spark.readStream.schema(shape).parquet(path))
        q = told.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(
            lambda df, _: df.write.mode("append").parquet(out)).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    rows = spark.read.parquet(out).collect()
    fired = sorted((r.job_id, r.done, r.failed) for r in rows if r.finalize)
    assert fired == [("a", 2, 0), ("b", 0, 1), ("c", 4, 0)]
    assert sorted(max((r.done, r.failed) for r in rows if r.job_id == j) for j in "abc") == [(1, 1), (2, 1), (4, 0)]


def test_progress_matches_batch(spark, tmp_path):
    p = tables.progress(spark, SF_DIR)
    p = ST.event_time(p)
    path = str(tmp_path / "in")
    ranked = p.withColumn("_part", F.ntile(3).over(Window.orderBy("ts", "event_id")))
    for part in (1, 2, 3):  # batches in the order of time
        ranked.filter(F.col("_part") == part).drop("_part").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = _run(ST.progress_state(stream), "progress_out", tmp_path)
    want = J.monotone_progress(p).select("job_id", "event_id", "progress", "shown_stage")
    assert got.exceptAll(want).count() == 0 and got.count() == p.count()


def test_rate_windows_match_batch(spark, tmp_path):
    e = _events(spark).orderBy("ts").select("event_id", "ts", "user_id")
    end = e.agg(F.max("ts")).first()[0]
    tail = spark.createDataFrame([(10**9, end + dt.timedelta(days=1), -1)], e.schema)
    path = str(tmp_path / "in")
    e.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = ST.requests_per_minute(stream, limit=1).writeStream.format("memory").queryName("rates").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    tail.write.mode("append").parquet(path)
    q.processAllAvailable()
    q.stop()
    got = spark.table("rates").filter("user_id >= 0")
    want = e.groupBy("user_id", F.date_trunc("minute", "ts").alias("minute")).agg(F.count(F.lit(1)).alias("requests")).withColumn(
        "limited", F.col("requests") > 1)
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


def _states(spark, tmp_path, batches, profiles, lateness, name):
    """All rows that the subscription stream puts out when each batch is a start of its own."""
    path, out = str(tmp_path / f"in-{name}"), str(tmp_path / f"out-{name}")
    for rows in batches:
        rows.coalesce(1).write.mode("append").parquet(path)
        told = ST.subscription_changes(spark.readStream.schema(rows.schema).parquet(path), profiles, lateness)
        q = told.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / f"cp-{name}")).foreachBatch(
            lambda df, n: df.withColumn("n", F.lit(n)).write.mode("append").parquet(out)).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    return spark.read.parquet(out)


def test_subscription_states_in_any_order_with_restarts(spark, tmp_path):
    profiles = tables.profiles(spark, SF_DIR)
    # Only notices whose key no other subscription has; some come a second time.
    notices = tables.webhooks(spark, SF_DIR)
    routed = PY.route(PY.parse_notices(notices))
    alone = routed.groupBy("dedup_key").agg(F.count_distinct("subscription_id").alias("_k"), F.count(F.lit(1)).alias("_m")).filter("_k = 1 and _m = 1")
    notices = notices.join(routed.select("event_id", "dedup_key").join(alone, "dedup_key").select("event_id"), "event_id").cache()
    routed = PY.route(PY.parse_notices(notices))
    changes = PY.with_profile(PY.first_deliveries(routed.filter(F.col("action").isin("activate", "deactivate"))), profiles)
    want = PY.subscription_states(changes, profiles).select(
        "user_id", "subscription_active", "plan", "subscription_credits",
        *[F.unix_seconds(c).alias(c) for c in ("subscription_contract_end", "subscription_expiry", "subscription_period_start")])
    assert want.count() >= 5
    shuffled = [notices.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == i) for i in (2, 0, 1)]
    got = _states(spark, tmp_path, [*shuffled, shuffled[1]], profiles, "3650 days", "any").filter("not lapsed")
    last = got.groupBy("user_id").agg(F.max_by(F.struct(*want.columns[1:]), "n").alias("s")).select("user_id", "s.*")
    assert last.exceptAll(want).count() == 0 and want.exceptAll(last).count() == 0
    again = got.filter("n = 3").count()
    assert again == 0  # what was delivered before changes nothing


def test_paid_time_ends_by_timer(spark, tmp_path):
    profiles = spark.createDataFrame([(1, "monthly", 0, "s1"), (2, "monthly", 5, "s2")], "id bigint, plan string, free_credits int, subscription_id string").withColumns(
        {c: F.lit(None).cast("timestamp") for c in ("subscription_expiry", "subscription_contract_end", "subscription_period_start")})

    def batch(*rows):
        body = lambda s, end: '{"event": "subscription.charged", "payload": {"subscription": {"entity": {"id": "%s", "current_end": "%d"}}}}' % (s, end)
        return spark.createDataFrame([(i, body(s, end), at) for i, s, at, end in rows], "event_id bigint, body string, at bigint").select(
            "event_id", "body", F.timestamp_seconds("at").alias("received_at"))

    day, t0 = 86_400, 1_700_000_000
    first = batch((1, "s1", t0, t0 + 30 * day), (2, "s2", t0, t0 + 30 * day))
    renewed = batch((3, "s2", t0 + 29 * day, t0 + 60 * day))
    later = batch((4, "s9", t0 + 40 * day, t0 + 99 * day))  # nobody's, but time goes on
    rows = _states(spark, tmp_path, [first, renewed, later, later], profiles, "1 day", "timer").collect()
    assert [(r.user_id, r.subscription_credits) for r in rows if r.lapsed] == [(1, 0)]
    assert {r.user_id: r.subscription_expiry for r in sorted(rows, key=lambda r: r.n)} == {1: t0 + 30 * day, 2: t0 + 60 * day}


def test_waits_and_routes(spark, tmp_path):
    e = _events(spark).select("event_id", F.concat(F.lit("j"), (F.col("user_id") % 5).cast("string")).alias("job_id"),
                              F.col("ts").alias("enqueued_at"), (F.col("ts") + F.expr("interval 2 seconds")).alias("dequeued_at"))
    got = _run(ST.queue_waits(_stream(spark, e, tmp_path)), "waits", tmp_path, "complete")
    want = e.groupBy("job_id").count()
    assert all(abs(r.queue_wait_s - 2 * r["count"]) < 1e-3 for r in got.join(want, "job_id").collect())
    f = spark.createDataFrame([(0,), (3,)], "attempt int")
    assert [(r.route, r.next_attempt) for r in ST.attempt_routes(f).collect()] == [("requeue", 1), ("failed", 3)]
