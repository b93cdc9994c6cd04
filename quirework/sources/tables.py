"""Scans of the driver tables and of the relational tables built from them.

The relational views give every later operator real, table-sized input: customers
stand in for profiles, orders for jobs, line items for usage rows and events for
requests, progress updates and payment notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, setting: str = "quirework.scan.tasks") -> DataFrame:
    """A scan dealt out evenly over as many tasks as the session setting names; without it, in the splits of its files.

    For inputs of fewer files and row groups than there are cores, such as a benchmark on one machine.
    """
    tasks = df.sparkSession.conf.get(setting, None)
    return df if tasks is None else df.repartition(int(tasks))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "documents"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One profile per customer; plan follows the market segment, wallet the balance."""
    c = table(spark, sf_dir, "customer")
    seg, key = F.col("c_mktsegment"), F.col("c_custkey")
    start = F.lit("1997-01-01").cast("timestamp_ntz")
    plan = (
        F.when(seg == "BUILDING", "monthly")
        .when(seg == "MACHINERY", "yearly")
        .when(seg == "AUTOMOBILE", "payg")
        .otherwise("free")
    )
    subscribed = plan.isin("monthly", "yearly")

    def day(n: Column) -> Column:
        return start + F.make_dt_interval(days=n.cast("int"))

    return c.select(
        key.alias("id"),
        F.concat(F.lit("User"), (key % 700).cast("string"), F.lit("@Example.com ")).alias("email"),
        plan.alias("plan"),
        (key % 7 * 1500).cast("int").alias("free_credits"),
        (key % 3 * 500).cast("int").alias("referral_bonus_words"),
        subscribed.alias("subscription_active"),
        F.when(subscribed, (key % 5 * 40000).cast("int")).otherwise(0).alias("subscription_credits"),
        F.when(subscribed & (key % 11 != 0), day(key % 300)).alias("subscription_period_start"),
        F.when(plan == "yearly", day(key % 300 + 365)).alias("subscription_contract_end"),
        F.when(subscribed & (key % 13 != 0), day(key % 300 + F.when(plan == "yearly", 365).otherwise(30)))
        .alias("subscription_expiry"),
        F.when(subscribed, F.concat(F.lit("sub_"), key.cast("string"))).alias("subscription_id"),
        F.col("c_acctbal").cast("decimal(12,2)").alias("credits_balance"),
        F.concat(F.lit("code"), key.cast("string")).alias("referral_code"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per order: P/F/O become pending/failed/completed."""
    o = table(spark, sf_dir, "orders")
    status = (
        F.when(F.col("o_orderstatus") == "P", "pending")
        .when(F.col("o_orderstatus") == "F", "failed")
        .otherwise("completed")
    )
    key = F.col("o_orderkey")
    return o.select(
        key.alias("id"),
        F.col("o_custkey").alias("user_id"),
        status.alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.when(status == "completed", F.col("o_orderdate") + F.expr("INTERVAL 2 HOURS")).alias("completed_at"),
        F.sha2((key % 50).cast("string"), 256).alias("content_hash"),
        (F.col("o_totalprice") / 10).cast("bigint").alias("tokens_used"),
        (key % 97 + 1).cast("double").alias("processing_seconds"),
        F.col("o_totalprice").alias("cost"),
        (key % 5).cast("int").alias("translation_attempt"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request-log row per event; ``value`` is the elapsed time."""
    e = table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    return e.select(
        F.element_at(F.array(F.lit(100), F.lit(500), F.lit(1000)), (F.col("user_id") % 3 + 1).cast("int"))
        .alias("level"),
        F.col("event_id").alias("idx"),
        F.when(failed, F.lit(503)).otherwise(200).alias("status"),
        F.col("value").alias("elapsed_s"),
        (~failed).alias("ok"),
        "ts",
        "user_id",
    )


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress updates: one job per user and day, percentages from the event payload."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    failed = F.col("event_type") == "error"
    return e.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("job_id"),
        "ts",
        "event_id",
        F.when(failed & (k % 2 == 0), 0).otherwise(k).alias("pct"),
        F.when(failed, "failed").otherwise(F.col("event_type")).alias("stage"),
    )


def webhooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment notices as JSON bodies in the gateway's nested shape, one per event."""
    from quirework.operators.ordered import pinned

    e = pinned(dealt(table(spark, sf_dir, "events")), {"k": F.get_json_object("props", "$.k").cast("int")})
    k, key = F.col("k"), F.col("event_id")
    named = (
        F.when(F.col("event_type") == "purchase", "payment.captured")
        .when(F.col("event_type") == "error", "payment.failed")
        .when(F.col("event_type") == "signup", "subscription.activated")
        .when((F.col("event_type") == "click") & (k % 4 == 0), "subscription.cancelled")
        .when(F.col("event_type") == "click", "invoice.paid")
        .otherwise("subscription.charged")
    )
    e = pinned(e, {"event": named})
    event = F.col("event")
    sub = F.concat(F.lit("sub_"), F.col("user_id").cast("string"))
    pay = F.concat(F.lit("pay_"), (key - key % 3).cast("string"))
    epoch = F.lit(1704067200) + k.cast("bigint") * 86400
    entity = F.struct(
        F.when(event.startswith("payment"), pay).otherwise(sub).alias("id"),
        F.when(event.startswith("payment") & (k % 3 == 0), sub).alias("subscription_id"),
        F.when(event == "payment.captured", F.concat(F.lit("order_"), key.cast("string"))).alias("order_id"),
        F.when(event.startswith("payment"), (F.col("value") * 100).cast("bigint")).alias("amount"),
        F.when(event == "payment.failed", F.lit("BAD_REQUEST")).alias("error_code"),
        F.when(event == "payment.failed", F.lit("card declined")).alias("error_description"),
        F.when(event.startswith("subscription") & (k % 2 == 0), epoch.cast("string")).alias("current_end"),
        F.when(event.startswith("subscription") & (k % 2 == 1), epoch.cast("string")).alias("charge_at"),
        F.when(event.startswith("subscription"), (epoch - 2592000).cast("string")).alias("current_start"),
        F.when(event == "payment.captured", F.struct(
            F.when(k % 3 != 0, F.lit("payg_translation")).alias("kind"),
            F.col("user_id").cast("string").alias("profile_id"),
            key.cast("string").alias("job_id"),
        )).alias("notes"),
    )
    invoice = F.struct(
        F.concat(F.lit("inv_"), key.cast("string")).alias("id"),
        F.when(k % 5 != 0, sub).alias("subscription_id"),
    )
    body = F.to_json(F.struct(
        F.when(k % 2 == 0, F.concat(F.lit("evt_"), (key - key % 2).cast("string"))).alias("id"),
        event.alias("event"),
        F.struct(
            F.when(event.startswith("payment"), F.struct(entity.alias("entity"))).alias("payment"),
            F.when(event == "invoice.paid", F.struct(invoice.alias("entity"))).alias("invoice"),
            F.when(event.startswith("subscription"), F.struct(entity.alias("entity"))).alias("subscription"),
        ).alias("payload"),
    ))
    rows = e.withColumn("received_at", F.col("ts"))
    return pinned(rows, {"body": body}).select("event_id", "received_at", "body")
