"""Referral claims, rewards and reports."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.config import DEFAULTS, Settings
from quirework.functions import clean as C
from quirework.operators.graph import TASK_EDGES, components
from quirework.operators.ordered import cut_lineage, first_per_key


def claim_verdicts(claims: DataFrame, profiles: DataFrame, attributions: DataFrame | None = None) -> DataFrame:
    """What each claim deserves on its own; ``_alone`` is null where it may be credited.

    Earlier attributions are reduced to one row per referee and one per device (two
    referee ids are enough to tell "somebody else") before they are joined.
    """
    code = C.referral_code(F.col("raw_code"))
    rows = claims.select(
        "claim_id", "referee_id", "claimed_at", code.alias("code"), C.device_hash(F.col("device_id")).alias("device")
    )
    me = profiles.select(F.col("id").alias("referee_id"), C.email_key(F.col("email")).alias("_my_email"),
                         F.lit(True).alias("_known"))
    by_code = profiles.filter(F.col("referral_code").isNotNull()).select(
        F.col("referral_code").alias("code"), F.col("id").alias("referrer_id"),
        C.email_key(F.col("email")).alias("_their_email"),
    )
    seen = rows.join(me, "referee_id", "left").join(by_code, "code", "left")
    had, reused = F.lit(False), F.lit(False)
    if attributions is not None:
        linked = attributions.select(F.col("referee_user_id").alias("referee_id"), F.lit(True).alias("_had")).distinct()
        used = attributions.filter(F.col("device_hash").isNotNull()).groupBy(
            F.col("device_hash").alias("device")
        ).agg(F.min("referee_user_id").alias("_u1"), F.max("referee_user_id").alias("_u2"))
        seen = seen.join(linked, "referee_id", "left").join(used, "device", "left")
        had = F.col("_had")
        reused = (F.col("_u1") != F.col("referee_id")) | (F.col("_u2") != F.col("referee_id"))
    verdict = (
        F.when(F.length("code") < 3, "too_short")
        .when(had, "already_attributed")
        .when(F.col("_known").isNull() | F.col("referrer_id").isNull(), "invalid_code")
        .when(F.col("referrer_id") == F.col("referee_id"), "self_referral")
        .when(F.col("_my_email") == F.col("_their_email"), "email_blocked")
        .when(F.coalesce(reused, F.lit(False)), "device_reused")
    )
    return seen.select("claim_id", "referee_id", "referrer_id", "device", "claimed_at", verdict.alias("_alone"))


#: Claims that one task folds in order.
_FOLD_CLAIMS = 200_000


def _by_rounds(open_claims: DataFrame) -> DataFrame:
    """Claims credited in order, for components too large for one task.

    Each round credits the claims that are the earliest left for both their referee and
    their device, then drops what those referees and devices still ask for. A hot device ends in one
    round; only a chain of ever later claims through different referees and devices takes a round per link.
    """
    order = F.struct("claimed_at", "claim_id")
    left = cut_lineage(open_claims)
    won = left.limit(0)
    while not left.isEmpty():
        by_referee = left.groupBy("referee_id").agg(F.min(order).alias("_r"))
        by_device = left.filter(F.col("device").isNotNull()).groupBy("device").agg(F.min(order).alias("_d"))
        placed = left.join(by_referee, "referee_id").join(by_device, "device", "left")
        wins = cut_lineage(
            placed.filter((F.col("_r") == order) & (F.col("_d").isNull() | (F.col("_d") == order))).select(*left.columns))
        won = won.unionByName(wins)
        left = cut_lineage(
            left.join(wins.select("referee_id"), "referee_id", "left_anti")
            .join(wins.filter(F.col("device").isNotNull()).select("device"), "device", "left_anti")
        )
    return won


def _in_order(table: pa.Table) -> pa.Table:
    """The claims of whole components that are credited when taken in order."""
    table = table.sort_by([("claimed_at", "ascending"), ("claim_id", "ascending")])
    referees, devices, won = set(), {None}, []
    for i, (referee, device) in enumerate(zip(table.column("referee_id").to_pylist(), table.column("device").to_pylist(), strict=True)):
        if referee not in referees and (device is None or device not in devices):
            referees.add(referee)
            devices.add(device)
            won.append(i)
    return table.take(pa.array(won, pa.int64()))


def _credited(open_claims: DataFrame) -> DataFrame:
    """Claims credited when all are taken in order: one per referee, one referee per device.

    A claim that shares neither referee nor device is credited as it is. The others fall into components of the graph of
    referees and devices, which decide nothing for each other: components are dealt into tasks that take their claims in order,
    however long their chains. Only a component of more than ``_FOLD_CLAIMS`` claims goes by rounds.
    """
    claims = open_claims.select("claim_id", "referee_id", "device", "claimed_at")
    same_referee = claims.groupBy("referee_id").agg(F.count(F.lit(1)).alias("_nr"))
    same_device = claims.filter(F.col("device").isNotNull()).groupBy("device").agg(F.count(F.lit(1)).alias("_nd"))
    counted = cut_lineage(claims.join(same_referee, "referee_id").join(same_device, "device", "left"))
    tangled = (F.col("_nr") > 1) | (F.coalesce("_nd", F.lit(0)) > 1)
    free, rest = counted.filter(~tangled), counted.filter(tangled)
    node = lambda kind, c: F.xxhash64(F.lit(kind), F.col(c))
    own = node("referee", "referee_id")
    rest = rest.withColumns({"a": own, "b": F.when(F.col("device").isNull(), own).otherwise(node("device", "device"))})
    n = rest.count()
    placed = rest.join(components(rest.select("a", "b"), n_edges=n if n <= TASK_EDGES else None).withColumnRenamed("node", "a"), "a", "left")
    placed = placed.withColumn("component", F.coalesce("component", "a"))
    names, slow = claims.columns, None
    if n > _FOLD_CLAIMS:
        placed = cut_lineage(placed)
        large = placed.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > _FOLD_CLAIMS).select("component")
        slow = _by_rounds(placed.join(large, "component", "left_semi").select(*names))
        placed = placed.join(large, "component", "left_anti")
    bucket = F.pmod(F.xxhash64("component"), F.lit(max(1, -(-2 * n // _FOLD_CLAIMS)))).alias("_bucket")
    folded = placed.select(bucket, *names).groupBy("_bucket").applyInArrow(
        lambda t: _in_order(t).select(names), ", ".join(f"{c} {claims.schema[c].dataType.simpleString()}" for c in names))
    out = free.select(*names).unionByName(folded)
    return out if slow is None else out.unionByName(slow)


def settle_claims(claims: DataFrame, profiles: DataFrame, attributions: DataFrame | None = None) -> DataFrame:
    """The six outcomes, with the batch's own claims taken into account in order."""
    alone = cut_lineage(claim_verdicts(claims, profiles, attributions))
    order = F.struct("claimed_at", "claim_id")
    won = _credited(alone.filter(F.col("_alone").isNull()))
    mine = won.select("referee_id", F.col("claim_id").alias("_won"), order.alias("_when"))
    ranked = alone.join(mine, "referee_id", "left")
    late = F.coalesce(F.col("_when") < order, F.lit(False))
    outcome = (
        F.when(F.col("_alone") == "too_short", "invalid_code")
        .when(late, "already_attributed")
        .when(F.col("_alone").isNotNull(), F.col("_alone"))
        .when(F.col("_won") == F.col("claim_id"), "credited")
        .otherwise("device_reused")
    )
    return ranked.select("claim_id", "referee_id", "referrer_id", "device", "claimed_at", outcome.alias("outcome"))


def signup_bonus_rows(outcomes: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Ledger rows of credited claims."""
    return outcomes.filter(F.col("outcome") == "credited").select(
        F.col("referee_id").alias("user_id"), F.lit("referral_signup_bonus").alias("type"),
        F.lit(cfg.signup_bonus_words).alias("credits"),
        F.concat(F.lit("referee_signup_bonus:"), F.col("claim_id").cast("string")).alias("idempotency_key"),
        F.col("claimed_at").alias("created_at"),
    )


def append_once(ledger: DataFrame | None, rows: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """New ledger rows, first per key and none the ledger already holds."""
    once = first_per_key(rows, [key], ["created_at"])
    return once if ledger is None else once.join(ledger.select(key), key, "left_anti")


def funnel(attributions: DataFrame) -> DataFrame:
    """A1 + A2: counts per referrer in one pass."""
    st, paid = F.col("status"), F.col("words_credited_to_referrer") > 0
    return attributions.groupBy(F.col("referrer_user_id").alias("referrer_id")).agg(
        F.count(F.lit(1)).alias("invites_total"),
        F.count_if(st == "pending").alias("pending_signup"),
        F.count_if(st == "verified").alias("verified_pending_use"),
        F.count_if((st == "completed") & paid).alias("rewarded_completed"),
        F.count_if(st == "completed").alias("successful_conversions"),
        F.count_if(paid).alias("started_rewards"),
    )


def qualifying_payers(profiles: DataFrame, transactions: DataFrame, wallet_provider: str = "wallet") -> DataFrame:
    """A3: users with a completed wallet payment or a started subscription."""
    paid = transactions.filter(
        (F.col("status") == "completed") & (F.col("provider") == wallet_provider) & (F.col("amount") > 0)
    ).select(F.col("user_id").alias("id")).distinct()
    started = profiles.filter(F.col("subscription_started_at").isNotNull()).select("id")
    return paid.union(started).distinct()


def status_message(status: Column, words: Column, cfg: Settings = DEFAULTS) -> Column:
    """B16."""
    v, p = cfg.verify_reward_words, cfg.payment_reward_words
    total = v + p
    w = F.format_number(words, 0)
    return (
        F.when(status == "pending", F.lit(
            f"Friend signed up. You earn {v:,} words when they verify email and sign in; "
            f"then {p:,} more when they pay (PAYG or subscription)—{total:,} words total."))
        .when((status == "verified") & (words >= total), F.lit(f"+{total:,} words from this invite."))
        .when((status == "verified") & (words >= v), F.concat(
            F.lit("+"), w, F.lit(f" words added. +{p:,} words pending until their first payment.")))
        .when((status == "verified") & (words > 0), F.concat(F.lit("+"), w, F.lit(" words added. Remaining bonus pending.")))
        .when(status == "verified", F.lit(
            f"Friend verified. +{v:,} words could not be added (referral limit). +{p:,} words still pending until they pay."))
        .when((status == "completed") & (words > 0), F.concat(F.lit("+"), w, F.lit(" words added from this invite.")))
        .when(status == "completed", F.lit("Completed — referral reward limit reached."))
        .otherwise("")
    )


def masked_email(email: Column) -> Column:
    """First character and domain."""
    domain = F.regexp_extract(email, "^[^@]*@([\\s\\S]*)$", 1)
    head = F.regexp_extract(email, "^([^@]?)", 1)
    return F.when(email.contains("@"), F.concat(head, F.lit("***@"), domain))


def invites(attributions: DataFrame, profiles: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Invitations with masked referee email and message."""
    emails = profiles.select(F.col("id").alias("referee_user_id"), "email")
    return attributions.join(emails, "referee_user_id").select(
        F.col("referrer_user_id").alias("referrer_id"), F.col("referee_user_id").alias("referee_id"), "status",
        masked_email(F.col("email")).alias("referee_email_masked"),
        status_message(F.col("status"), F.col("words_credited_to_referrer"), cfg).alias("ui_message"),
        "created_at",
    )


# --- rewards -----------------------------------------------------------------


def reward_events(attributions: DataFrame, events: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Words credited to referrers by verification and first payment, both caps applied.

    ``events`` holds (referee_id, kind verify|payment, at). Only an attribution among the
    first ``max_rewarded_referrals`` to start can ever earn: a slot is taken at the first
    credit and never freed. So per referrer at most that many attributions, two events
    each, reach the ordered step, found by a ranking Spark limits before its shuffle.
    """
    firsts = events.groupBy("referee_id").agg(
        F.min("at").alias("verified_at"),
        F.min(F.when(F.col("kind") == "payment", F.col("at"))).alias("paid_at"),
    )
    rows = attributions.select(
        F.col("referee_user_id").alias("referee_id"), F.col("referrer_user_id").alias("referrer_id")
    ).join(firsts, "referee_id", "left")
    # without a verify reward a slot is taken by the payment; otherwise by the first event,
    # as a payment of a confirmed referee runs the verify step first
    opened = "verified_at" if cfg.verify_reward_words > 0 else "paid_at"
    slot = F.row_number().over(Window.partitionBy("referrer_id").orderBy(opened, "referee_id"))
    started = rows.filter(F.col(opened).isNotNull()).withColumn("_slot", slot).filter(
        F.col("_slot") <= cfg.max_rewarded_referrals
    )
    v, p, cap = cfg.verify_reward_words, cfg.payment_reward_words, cfg.max_words_per_referrer

    def grant(group: pd.DataFrame) -> pd.DataFrame:
        steps = []
        for r in group.itertuples(index=False):
            steps.append((r.verified_at, r.referee_id, 0, v))
            if not pd.isna(r.paid_at):
                steps.append((r.paid_at, r.referee_id, 1, v + p))
        earned, per = 0, dict.fromkeys(group["referee_id"], 0)
        for _, referee, _, target in sorted(steps):
            words = max(0, min(target - per[referee], cap - earned))
            per[referee] += words
            earned += words
        out = group[["referrer_id", "referee_id"]].copy()
        out["words"] = [per[r] for r in out["referee_id"]]
        return out

    granted = started.select("referrer_id", "referee_id", "verified_at", "paid_at").groupBy("referrer_id").applyInPandas(
        grant, "referrer_id bigint, referee_id bigint, words bigint"
    )
    status = (
        F.when(F.col("paid_at").isNotNull(), "completed").when(F.col("verified_at").isNotNull(), "verified")
        .otherwise("pending")
    )
    return rows.join(granted, ["referrer_id", "referee_id"], "left").select(
        "referrer_id", "referee_id", status.alias("status"), F.coalesce("words", F.lit(0)).alias("words")
    )


def verify_only_rewards(attributions: DataFrame, events: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """B11 before any payment: closed form over the first slots of each referrer."""
    firsts = events.filter(F.col("kind") == "verify").groupBy("referee_id").agg(F.min("at").alias("at"))
    rows = attributions.select(
        F.col("referee_user_id").alias("referee_id"), F.col("referrer_user_id").alias("referrer_id")
    ).join(firsts, "referee_id")
    order = Window.partitionBy("referrer_id").orderBy("at", "referee_id")
    slots = rows.withColumn("slot", F.row_number().over(order)).filter(F.col("slot") <= cfg.max_rewarded_referrals)
    v, cap = cfg.verify_reward_words, cfg.max_words_per_referrer
    words = F.least(F.lit(cap), F.col("slot") * v) - F.least(F.lit(cap), (F.col("slot") - 1) * v)
    return slots.select("referrer_id", "referee_id", "slot", words.alias("words")).filter(F.col("words") > 0)
