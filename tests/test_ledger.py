from __future__ import annotations

import datetime as dt
import json
import random

import pandas as pd
from conftest import SF_DIR

from pyspark.sql import functions as F

from quirework.config import Settings
from quirework.operators import billing as B
from quirework.operators import jobs as J
from quirework.operators import payments as PY
from quirework.operators import quality as Q
from quirework.operators import referral as R

T0 = dt.datetime(2024, 1, 1)
PROFILE = (
    "id bigint, email string, plan string, free_credits int, referral_bonus_words int, subscription_active boolean, "
    "subscription_credits int, subscription_period_start timestamp, subscription_contract_end timestamp, "
    "subscription_expiry timestamp, subscription_id string, credits_balance decimal(12,2), referral_code string"
)


def _profiles(spark, *rows):
    base = dict(email=None, plan="free", free_credits=0, referral_bonus_words=0, subscription_active=False, subscription_credits=0,
                subscription_period_start=None, subscription_contract_end=None, subscription_expiry=None, subscription_id=None,
                credits_balance=None, referral_code=None)
    names = [f.rsplit(" ", 1)[0] for f in PROFILE.replace("(12,2)", "").split(", ")]
    return spark.createDataFrame([tuple({**base, **r}.get(n) for n in names) for r in rows], PROFILE)


def day(n):
    return T0 + dt.timedelta(days=n)


def test_expired_subscription_gives_no_pool(spark):
    p = _profiles(spark, dict(id=1, plan="monthly", subscription_active=True, subscription_credits=5000, subscription_expiry=day(-1)))
    fresh = B.refresh_subscription(p, F.lit(T0))
    r = B.charge_split(fresh.withColumn("words", F.lit(1_000_000))).first()
    assert (r.subscription_used, r.payg_words, r.plan, r.user_plan_type, r.amount_to_pay) == (0, 1_000_000, "payg", "payg", 990.0)


def test_settlement_equals_job_by_job(spark):
    """Against refresh, split and deduct for every job in turn."""
    rng = random.Random(11)
    users, jobs, want = [], [], {}
    for u in range(60):
        yearly = u % 3 == 0
        sub = yearly or u % 3 == 1
        start, contract = day(rng.randint(-40, 20)), day(rng.randint(60, 200))
        expiry = contract + dt.timedelta(days=rng.choice([0, 0, 30])) if yearly else day(rng.randint(5, 120))
        users.append(dict(id=u, plan="yearly" if yearly else "monthly" if sub else "free", free_credits=rng.choice([0, 700, 5000]),
                          referral_bonus_words=rng.choice([0, 300]), subscription_active=sub, subscription_credits=rng.choice([0, 4000]) if sub else 0,
                          subscription_period_start=start if yearly else None, subscription_contract_end=contract if yearly else None,
                          subscription_expiry=expiry if sub else None))
        s = dict(users[-1])
        times = sorted(day(0) + dt.timedelta(hours=rng.randint(0, 24 * 260)) for _ in range(rng.randint(1, 25)))
        for i, at in enumerate(times):
            words = rng.choice([0, 100, 900, 700_000])
            jobs.append((u, u * 100 + i, at, words))
            if s["subscription_active"]:
                if yearly and at < s["subscription_contract_end"]:
                    nxt = s["subscription_period_start"] + dt.timedelta(days=30)
                    while at >= nxt and nxt <= s["subscription_contract_end"]:
                        s["subscription_period_start"], s["subscription_credits"] = nxt, 2_000_000
                        nxt += dt.timedelta(days=30)
                if s["subscription_expiry"] < at:
                    s |= {"subscription_active": False, "subscription_credits": 0}
            free = s["free_credits"] + s["referral_bonus_words"]
            f = min(words, free)
            x = min(words - f, s["subscription_credits"] if s["subscription_active"] else 0)
            take = min(f, s["free_credits"])
            s["free_credits"] -= take
            s["referral_bonus_words"] -= f - take
            s["subscription_credits"] -= x
            want[u * 100 + i] = (f, x, words - f - x)
    df = spark.createDataFrame(jobs, "user_id bigint, job_id bigint, at timestamp, words bigint")
    got = {r.job_id: (r.free_used, r.subscription_used, r.payg_words) for r in B.settle(df, _profiles(spark, *users)).collect()}
    assert got == want


def test_subscription_states_worked_by_hand(spark):
    on, off = "activate", "deactivate"
    cases = {  # plan, free words, expiry, changes as (day, action, period end, period start) -> active, plan, contract, expiry, start
        1: (("free", 10, None), [(0, on, None, None)], (True, "monthly", None, 30, 0)),
        2: (("yearly", 0, None), [(0, on, 400, None), (9, off, None, None)], (False, "payg", None, 400, 0)),
        3: (("yearly", 0, None), [(0, on, None, None)], (True, "yearly", 365, 365, 0)),
        4: (("monthly", 5, 100), [(0, on, 50, 2)], (True, "monthly", None, 100, 2)),
        5: (("yearly", 10, None), [(0, on, None, None), (9, off, None, None), (18, on, None, None)], (True, "monthly", None, 48, 0)),
    }
    users = [dict(id=u, plan=p, free_credits=f, subscription_id=f"s{u}", subscription_expiry=None if e is None else day(e))
             for u, ((p, f, e), _, _) in cases.items()]
    at = lambda d: None if d is None else day(d)
    changes = [(u, day(d), u * 10 + i, act, at(pe), at(ps)) for u, (_, rows, _) in cases.items() for i, (d, act, pe, ps) in enumerate(rows)]
    df = spark.createDataFrame(changes, "user_id bigint, received_at timestamp, event_id bigint, action string, period_end timestamp, period_start timestamp")
    got = {r.user_id: (r.subscription_active, r.plan, r.subscription_contract_end, r.subscription_expiry, r.subscription_period_start)
           for r in PY.subscription_states(df, _profiles(spark, *users)).collect()}
    assert got == {u: (w[0], w[1], at(w[2]), at(w[3]), at(w[4])) for u, (_, _, w) in cases.items()}


def test_refills_do_not_depend_on_the_time_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            t = lambda s: F.lit(s).cast("timestamp_ntz")
            p = spark.range(1).select(
                F.lit("yearly").alias("plan"), F.lit(True).alias("subscription_active"), t("2024-02-15 00:30:00").alias("subscription_period_start"),
                t("2025-02-15 00:30:00").alias("subscription_contract_end"), t("2025-02-15 00:30:00").alias("subscription_expiry"))
            assert p.select(B.refills_until(t("2024-03-16 00:30:00")).alias("k")).first().k == 1
            changes = p.select(F.lit(1).alias("user_id"), t("2024-03-01 00:00:00").alias("received_at"), F.lit(1).alias("event_id"), F.lit("activate").alias("action"),
                               F.lit(None).cast("timestamp").alias("period_end"), F.lit(None).cast("timestamp").alias("period_start"))
            who = p.select(F.lit(1).alias("id"), F.lit("free").alias("plan"), F.lit(0).alias("free_credits"), *[F.lit(None).cast("timestamp_ntz").alias(c) for c in (
                "subscription_expiry", "subscription_contract_end", "subscription_period_start")])
            end = PY.subscription_states(changes, who).select(F.unix_seconds("subscription_expiry").alias("s")).first().s
            assert end == 1709251200 + 30 * 86400
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def _notice(spark, *bodies):
    rows = [(i, day(i), json.dumps(b)) for i, b in enumerate(bodies)]
    return PY.route(PY.parse_notices(spark.createDataFrame(rows, "event_id bigint, received_at timestamp, body string")))


def test_notice_keys_and_routes(spark):
    ent = lambda **kw: {"entity": kw}
    rows = _notice(
        spark,
        {"id": "evt_1", "event": "subscription.charged", "payload": {"subscription": ent(id="s1", current_end=1704067200)}},
        {"event": "invoice.paid", "payload": {"invoice": ent(id="i1", subscription_id="s2")}},
        {"event": "subscription.activated", "payload": {"subscription": ent(id="s3", charge_at="1704067200", current_start="x")}},
        {"event": "payment.captured", "payload": {"payment": ent(id="p1", order_id="o1", amount=1250, notes={"kind": "payg_translation", "profile_id": "7", "job_id": "9"})}},
        {"event": "payment.captured", "payload": {"payment": ent(id="p2", subscription_id="s1", notes=[])}},
        {"event": "payment.failed", "payload": {"payment": ent(id="p3", error_code="E")}},
        {"event": "subscription.halted", "payload": {"subscription": ent(id="s1")}},
        {"event": "subscription.halted", "payload": {}},
    ).orderBy("event_id").collect()
    assert [r.dedup_key for r in rows] == [
        "evt_1", "invoice.paid:inv_i1", "subscription.activated:sub_s3:ce_1704067200", "payment.captured:pay_p1",
        "payment.captured:pay_p2", "payment.failed:pay_p3", "subscription.halted:sub_s1", None]
    assert [r.action for r in rows] == ["activate", "activate", "activate", "capture", "activate", "failure", "deactivate", "ignore"]
    assert rows[1].subscription_id == "s2" and rows[0].period_end == T0 and rows[2].period_start is None and rows[3].amount == 12.5


def test_same_payment_credits_once(spark):
    pay = {"event": "payment.captured", "payload": {"payment": {"entity": {
        "id": "p1", "order_id": "o", "amount": 10000, "notes": {"kind": "payg_translation", "profile_id": "1", "job_id": "5"}}}}}
    caps = PY.wallet_credits(_notice(spark, pay, pay).filter(F.col("action") == "capture"))
    p = _profiles(spark, dict(id=1)).withColumn("credits_balance", F.lit(0).cast("decimal(12,2)"))
    assert float(PY.wallet_balances(p, caps).first()["credits_balance"]) == 100.0
    assert PY.wallet_credits(caps, spark.createDataFrame([("p1",)], "external_id string")).count() == 0
    jobs = spark.createDataFrame([(5, 1, "awaiting_payment", 2), (5, 2, "awaiting_payment", 2)], "id bigint, user_id bigint, status string, translation_attempt int")
    assert {(r.user_id, r.status, r.translation_attempt) for r in PY.activate_paid_jobs(jobs, caps).collect()} == {(1, "pending", 0), (2, "awaiting_payment", 2)}


def test_claim_outcomes(spark):
    p = _profiles(spark, dict(id=1, email="A@x.com", referral_code="aaa"), dict(id=2, email=" a@X.com "), dict(id=3, email="c@x.com"),
                  dict(id=4, email="d@x.com"), dict(id=5, email="e@x.com"), dict(id=6, email="f@x.com"))
    c = spark.createDataFrame(
        [(1, 3, " AAA ", "device-one", day(1)), (2, 1, "aaa", None, day(1)), (3, 2, "aaa", None, day(1)), (4, 4, "zz", None, day(1)),
         (5, 4, "zzz", None, day(2)), (6, 5, "aaa", "device-one", day(2)), (7, 3, "aaa", None, day(3)), (8, 5, "aaa", "device-two", day(4)),
         (9, 6, "aaa", "short", day(5)), (10, 9, "aaa", None, day(5))],
        "claim_id bigint, referee_id bigint, raw_code string, device_id string, claimed_at timestamp")
    out = R.settle_claims(c, p)
    assert {r.claim_id: r.outcome for r in out.collect()} == {
        1: "credited", 2: "self_referral", 3: "email_blocked", 4: "invalid_code", 5: "invalid_code", 6: "device_reused",
        7: "already_attributed", 8: "credited", 9: "credited", 10: "invalid_code"}
    rows = R.signup_bonus_rows(out)
    assert R.append_once(None, rows.unionByName(rows)).count() == 3
    again = spark.createDataFrame([(3, "aaa", None)], "referee_user_id bigint, x string, device_hash string")
    assert {r.outcome for r in R.settle_claims(c.filter("claim_id = 1"), p, again).collect()} == {"already_attributed"}


def test_rewards_equal_event_by_event(spark):
    rng = random.Random(9)
    cfg = Settings(max_words_per_referrer=23_500, max_rewarded_referrals=4)
    attr = [(i, i, i % 5) for i in range(60)]
    events = [(i, rng.choice(["verify", "payment"]), T0 + dt.timedelta(minutes=rng.randint(0, 5000) * 100 + i)) for i in range(60) for _ in range(rng.randint(0, 3))]
    words = dict.fromkeys(range(60), 0)
    status = dict.fromkeys(range(60), "pending")
    for i, kind, _ in sorted(events, key=lambda e: (e[2], e[0])):
        mates = [j for j in range(60) if j % 5 == i % 5]
        room = cfg.max_words_per_referrer - sum(words[j] for j in mates)
        if status[i] == "completed":
            continue
        status[i] = "verified"
        if words[i] < 3000 and sum(words[j] > 0 for j in mates) < 4:
            g = max(0, min(3000 - words[i], room)) if words[i] == 0 else 0
            words[i] += g
            room -= g
        if kind == "payment":
            status[i] = "completed"
            started = sum(words[j] > 0 for j in mates)
            if not (words[i] < 3000 and started >= 4):
                words[i] += max(0, min(10_000 - words[i], room))
    a = spark.createDataFrame(attr, "id bigint, referee_user_id bigint, referrer_user_id bigint")
    e = spark.createDataFrame(events, "referee_id bigint, kind string, at timestamp")
    got = {r.referee_id: (r.status, r.words) for r in R.reward_events(a, e, cfg).collect()}
    assert got == {i: (status[i], words[i]) for i in range(60)}


def test_percentiles_match_linear_interpolation(spark):
    rng = random.Random(2)
    rows = [(k, round(rng.expovariate(0.3), rng.choice([1, 6]))) for k in (1, 2) for _ in range(777 if k == 1 else 1)]
    got = {(r.k, r.p): r.value for r in J.exact_percentiles(spark.createDataFrame(rows, "k int, v double"), "k", "v", [0.0, 0.5, 0.99, 1.0]).collect()}
    for k in (1, 2):
        s = pd.Series([v for kk, v in rows if kk == k])
        assert all(abs(got[(k, p)] - s.quantile(p)) < 1e-9 for p in (0.0, 0.5, 0.99, 1.0))


def test_constraint_rows(spark):
    p = spark.createDataFrame([(1, "a", 5), (2, "a", -1), (3, None, None)], "id int, code string, n int")
    rep = Q.constraint_report([Q.unique_violations("p", p, ["code"]), Q.check_violations("p", p, "n", F.col("n") >= 0),
                               Q.null_violations("p", p, "code"), Q.orphan_violations("p", p, "n", p, "id")])
    assert [r.violations for r in rep.collect()] == [1, 1, 1, 2]


def test_percentiles_of_many_skewed_values(spark):
    """Brackets by sketch, exact values inside: ties, heavy tails and a key with few rows."""
    rows = spark.range(60_000).select(
        (F.col("id") % 2).cast("int").alias("k"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.pow(F.lit(1.0003), F.col("id") * 37 % 59_999)).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(5, 1.0), (5, 4.0), (5, None)], "k int, v double")).cache()
    probs = [0.0, 0.25, 0.3333, 0.5, 0.95, 0.999, 1.0]
    got = {(r.k, r.p): r.value for r in J.exact_percentiles(rows, "k", "v", probs).collect()}
    frame = rows.toPandas().dropna()
    want = {(k, p): float(g.quantile(p)) for k, g in frame.groupby("k")["v"] for p in probs}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) <= 1e-9 * max(1.0, abs(want[x])) for x in want)


def test_pinned_columns_keep_the_size_estimate(spark):
    """Keys of parsed notices are estimated at a fair share of the events' size, so that a large table of them is not broadcast."""
    from quirework.sources import tables

    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    keys = PY.parse_notices(tables.webhooks(spark, SF_DIR)).select("event_id", "received_at", "dedup_key")
    assert size(keys) > 0.25 * size(tables.table(spark, SF_DIR, "events"))


def test_stage_report_shuffles_a_job_once(spark):
    """With the stages' names one row of sums per job is shuffled; the report is that of the maps taken apart."""
    rng = random.Random(3)
    names = ("b_s", "a_s", "chunk_x_sum_s", "translation_api_per_batch_wall_sum_s", "c_s")
    values = (0.0, 1.5, 1.5, 2.25, 40.0, None, float("nan"), -1.0)
    rows = [(j, rng.choice((None, 0.0, 12.5)), {n: rng.choice(values) for n in names}) for j in [*range(300), None] for _ in range(rng.randint(1, 4))]
    rows += [(7, 200.0, dict.fromkeys(names, 0.25))] * 500 + [(-1, None, dict.fromkeys(names))] * 2
    df = spark.createDataFrame(rows, "job_id bigint, e2e_wall_s double, stages map<string,double>").repartition(6)
    want, got = J.stage_report(df, digits=4), J.stage_report(df, digits=4, names=names)
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    table = spark.createDataFrame([(1, 2.0, 3.0)], "job_id bigint, x double, e2e_wall_s double")
    plan = J.stage_report(table.select("job_id", "e2e_wall_s", F.create_map(F.lit("a_s"), "x", F.lit("b_s"), F.col("x") * 2).alias("stages")), names=("a_s", "b_s"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Window" not in text and "map(" not in text


def test_stage_report_query_shuffles_once(spark):
    import __spark_entry__ as entry

    text = entry.queries()["stage_report"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Window" not in text
