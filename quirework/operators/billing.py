"""Word pools, charges and settlement.

Settling many jobs of one user in order needs no loop: what a pool gives to a job is
the difference of two clipped running sums. Refills only split the sums into epochs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.config import DEFAULTS, Settings
from quirework.functions.clean import payg_price

_DAY = 86_400


def _seconds(later: Column, earlier: Column) -> Column:
    """Whole seconds between two values of one timestamp type, zone-less ones without a zone."""
    gap = later - earlier
    part = lambda unit: F.extract(F.lit(unit), gap)
    return part("DAY") * _DAY + part("HOUR") * 3600 + part("MINUTE") * 60 + F.floor(part("SECOND"))


def _days(n: Column) -> Column:
    return F.make_dt_interval(days=n.cast("int"))


def _words(c: str) -> Column:
    return F.greatest(F.coalesce(F.col(c), F.lit(0)).cast("long"), F.lit(0))


def plan_without_subscription(free: Column) -> Column:
    return F.when(F.coalesce(free, F.lit(0)) <= 0, "payg").otherwise("free")


def refills_until(now: Column, cfg: Settings = DEFAULTS) -> Column:
    """Whole 30-day periods since the period start, within the contract; 0 unless yearly and live.

    A profile without a period start has none to count (the refresh sets it to now).
    """
    contract = F.coalesce("subscription_contract_end", "subscription_expiry")
    start = F.col("subscription_period_start")
    period = cfg.subscription_period_days * _DAY
    k = F.least(F.floor(_seconds(now, start) / period), F.floor(_seconds(contract, start) / period))
    rolls = (F.lower("plan") == "yearly") & F.col("subscription_active") & (now < contract)
    return F.when(rolls, F.greatest(F.coalesce(k, F.lit(0)), F.lit(0))).otherwise(0)


def subscription_live(now: Column) -> Column:
    expiry = F.col("subscription_expiry")
    return F.coalesce(F.col("subscription_active") & expiry.isNotNull() & (expiry >= now), F.lit(False))


def refresh_subscription(profiles: DataFrame, now: Column, cfg: Settings = DEFAULTS) -> DataFrame:
    """Roll yearly word buckets, deactivate expired subscriptions, fall back the plan."""
    if "subscription_started_at" in profiles.columns:
        profiles = profiles.withColumn(
            "subscription_period_start", F.coalesce("subscription_period_start", "subscription_started_at")
        )
    rolled = profiles.withColumns({
        "_k": refills_until(now, cfg),
        "_rolls": (F.lower("plan") == "yearly") & F.col("subscription_active")
        & F.coalesce(now < F.coalesce("subscription_contract_end", "subscription_expiry"), F.lit(False)),
        "_live": subscription_live(now),
    })
    start = F.col("subscription_period_start")
    ended = F.col("subscription_active") & ~F.col("_live")
    credits = F.when(F.col("_k") > 0, F.lit(cfg.subscription_pool_words)).otherwise(F.col("subscription_credits"))
    return rolled.withColumn("_ended", ended).withColumns({
        "subscription_period_start": F.when(
            F.col("_rolls"), F.coalesce(start + _days(F.col("_k") * cfg.subscription_period_days), now)
        ).otherwise(F.col("subscription_period_start")),
        "subscription_credits": F.when(F.col("_ended"), 0).otherwise(credits),
        "subscription_active": F.col("subscription_active") & ~F.col("_ended"),
        "plan": F.when(F.col("_ended"), plan_without_subscription(F.col("free_credits"))).otherwise(F.col("plan")),
    }).drop("_k", "_rolls", "_live", "_ended")


def plan_label(free: Column, subscription: Column, payg: Column) -> Column:
    return (
        F.when((payg > 0) & ((free > 0) | (subscription > 0)), "mixed")
        .when(payg > 0, "payg").when(subscription > 0, "subscription").otherwise("free")
    )


def charge_split(rows: DataFrame, words: str = "words", cfg: Settings = DEFAULTS) -> DataFrame:
    """Words of one job over free words, bonus words, subscription, pay-as-you-go.

    Expects refreshed profile columns beside the word count.
    """
    need = _words(words)
    fc, rb = _words("free_credits"), _words("referral_bonus_words")
    sub = F.when(F.col("subscription_active"), _words("subscription_credits")).otherwise(0)
    free_used = F.least(need, fc + rb)
    split = rows.withColumns({"free_used": free_used, "_sub": sub, "_pool": fc + rb}).withColumn(
        "subscription_used", F.least(need - F.col("free_used"), F.col("_sub"))
    ).withColumn("payg_words", need - F.col("free_used") - F.col("subscription_used"))
    return split.withColumns({
        "amount_to_pay": payg_price(F.col("payg_words"), cfg.payg_rate_per_100k),
        "remaining_words": F.greatest(
            F.lit(0), F.col("_pool") - F.col("free_used") + F.col("_sub") - F.col("subscription_used")
        ),
        "user_plan_type": plan_label(F.col("free_used"), F.col("subscription_used"), F.col("payg_words")),
    }).drop("_sub", "_pool")


def upload_estimate(docs: DataFrame, profiles: DataFrame, now: Column, cfg: Settings = DEFAULTS) -> DataFrame:
    """Charge and preview offer per uploaded document (profile columns by ``user_id``)."""
    from quirework.operators.preview import eligibility

    fresh = refresh_subscription(profiles, now, cfg).withColumnRenamed("id", "user_id")
    return eligibility(
        charge_split(docs.join(fresh, "user_id", "left"), cfg=cfg),
        max_pages=cfg.preview_max_pages, words_per_page=cfg.preview_words_per_page,
    )


def settle(jobs: DataFrame, profiles: DataFrame, cfg: Settings = DEFAULTS,
           chunk: str = "date_trunc('DAY', at)") -> DataFrame:
    """Charges of many jobs (``user_id, job_id, at, words``) in time order.

    A refill or the end of a subscription starts a new epoch. Word totals per (user,
    epoch, day) give, by prefix sums over those few rows, what was used before each
    day and before each epoch; rows are then summed inside their day only, so a
    user with a large share of all jobs is still settled by many tasks.
    """
    pools = profiles.select(
        F.col("id").alias("user_id"),
        (_words("free_credits") + _words("referral_bonus_words")).alias("_free"),
        _words("subscription_credits").alias("_sub"),
        "plan", "subscription_active", "subscription_period_start",
        "subscription_contract_end", "subscription_expiry",
    )
    at, ended, past_contract = F.col("at"), F.lit(1 << 40), F.lit((1 << 40) - 1)
    rows = jobs.select("user_id", "job_id", "at", _words("words").alias("words")).join(pools, "user_id")
    contract = F.coalesce("subscription_contract_end", "subscription_expiry")
    rows = rows.withColumns({
        "_refills": refills_until(at, cfg).cast("long"), "_live": subscription_live(at), "_chunk": F.expr(chunk),
        "_late": F.coalesce((F.lower("plan") == "yearly") & (at >= contract), F.lit(False)),
    })
    epoch = F.when(~F.col("_live"), ended).when(F.col("_late"), past_contract).otherwise(F.col("_refills"))
    rows = rows.select("user_id", "job_id", "at", "words", "_free", "_sub", "_chunk", epoch.alias("_epoch"))
    parts = ["user_id", "_epoch", "_chunk"]
    by_user = Window.partitionBy("user_id").orderBy("_epoch", "_chunk")
    earlier = F.coalesce(F.sum("_t").over(by_user.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # past the contract nothing is refilled: such jobs draw on the pool of the last refill
    filled = F.max(F.when(F.col("_epoch") < past_contract, F.col("_epoch"))).over(Window.partitionBy("user_id"))
    totals = (
        rows.groupBy(*parts).agg(F.sum("words").alias("_t"))
        .withColumns({
            "_before": earlier,
            "_pool_of": F.when(F.col("_epoch") == past_contract, F.coalesce(filled, F.lit(0)))
            .otherwise(F.col("_epoch")),
        })
        .withColumn("_base", F.min("_before").over(Window.partitionBy("user_id", "_pool_of")))
        .drop("_t")
    )
    in_day = Window.partitionBy(*parts).orderBy("at", "job_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_here", F.sum("words").over(in_day)).join(totals, parts)
    upto = F.col("_before") + F.col("_here")

    def beyond_free(cum: Column) -> Column:
        return cum - F.least(cum, F.col("_free"))

    drawn = beyond_free(upto) - beyond_free(F.col("_base"))
    rest = beyond_free(upto) - beyond_free(upto - F.col("words"))
    pool = (
        F.when(F.col("_epoch") == ended, F.lit(0))
        .when(F.col("_pool_of") > 0, F.lit(cfg.subscription_pool_words)).otherwise(F.col("_sub"))
    )
    sub = F.least(drawn, pool) - F.least(drawn - rest, pool)
    done = placed.withColumns({
        "free_used": F.col("words") - rest, "subscription_used": sub, "payg_words": rest - sub,
    })
    return done.select(
        "user_id", "job_id", "at", "words", "free_used", "subscription_used", "payg_words",
        payg_price(F.col("payg_words"), cfg.payg_rate_per_100k).alias("amount"),
    )


def settled_balances(charges: DataFrame, profiles: DataFrame) -> DataFrame:
    """Pools and wallet per user after a settlement, one aggregate over the charges."""
    used = charges.groupBy(F.col("user_id").alias("id")).agg(
        F.sum("free_used").alias("_f"), F.sum("amount").alias("_a")
    )
    fc, rb = _words("free_credits"), _words("referral_bonus_words")
    joined = profiles.join(used, "id", "left").withColumns({
        "_f": F.coalesce("_f", F.lit(0)), "_a": F.coalesce("_a", F.lit(0.0)),
    })
    free_left = F.greatest(fc - F.col("_f"), F.lit(0))
    return joined.select(
        "id",
        free_left.alias("free_credits"),
        F.greatest(F.least(rb, fc + rb - F.col("_f")), F.lit(0)).alias("referral_bonus_words"),
        F.round(F.col("credits_balance").cast("double") - F.col("_a"), 2).alias("credits_balance"),
        F.when(~F.col("subscription_active") & (free_left <= 0) & (F.lower("plan") == "free"), "payg")
        .otherwise(F.col("plan")).alias("plan"),
    )


def usage_rows(charges: DataFrame) -> DataFrame:
    """S9 payload: one usage row per settled job."""
    return charges.select("user_id", "job_id", F.col("words").alias("tokens_used"),
                          F.col("amount").cast("decimal(12,4)").alias("cost"), F.col("at").alias("created_at"))


def affordable(profiles: DataFrame, now: Column, payg: Column, cfg: Settings = DEFAULTS) -> DataFrame:
    """May start a job at all, and whether the wallet covers a pay-as-you-go slice."""
    expiry = F.col("subscription_expiry")
    live = (
        F.col("subscription_active") & (F.coalesce(F.col("subscription_credits"), F.lit(0)) > 0)
        & (expiry.isNull() | (expiry > now))
    )
    words = _words("free_credits") + _words("referral_bonus_words") > 0
    balance = F.coalesce(F.col("credits_balance").cast("double"), F.lit(0.0))
    return profiles.withColumns({
        "may_start": F.coalesce(live, F.lit(False)) | words | (balance >= cfg.minimum_charge),
        "wallet_covers": (payg <= 1e-9) | (payg <= balance + 1e-9),
    })
