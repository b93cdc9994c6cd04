"""Schema evolution, backfills and constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# column, type, default of columns later versions added to profiles and jobs (fixed values)
PROFILE_COLUMNS = (
    ("first_name", "string", None), ("last_name", "string", None), ("mobile", "string", None),
    ("city", "string", None), ("country", "string", None),
    ("referral_code", "string", None), ("referred_by_user_id", "bigint", None),
    ("referral_bonus_words", "int", 0), ("referral_words_earned_total", "int", 0),
    ("free_credits", "int", 10_000),
    ("subscription_active", "boolean", False), ("subscription_credits", "int", 0),
    ("subscription_expiry", "timestamp", None), ("subscription_started_at", "timestamp", None),
    ("subscription_period_start", "timestamp", None), ("subscription_contract_end", "timestamp", None),
    ("pending_subscription_kind", "string", None), ("subscription_id", "string", None),
)
JOB_COLUMNS = (
    ("input_filename", "string", ""), ("export_format", "string", "docx"), ("file_type", "string", None),
    ("content_hash", "string", None), ("tokens_used", "bigint", 0), ("cost", "decimal(10,2)", 0),
    ("processing_seconds", "double", None), ("updated_at", "timestamp", None),
    ("quoted_payg", "decimal(10,2)", 0), ("translation_attempt", "int", 0),
    ("translation_target", "string", "hinglish"),
)


def add_missing_columns(df: DataFrame, spec: tuple[tuple[str, str, object], ...]) -> DataFrame:
    """Columns a newer schema expects, with their defaults."""
    new = {n: F.lit(default).cast(t) for n, t, default in spec if n not in df.columns}
    return df.withColumns(new) if new else df


def rewrite_plan_slugs(plan: Column) -> Column:
    """X2."""
    return F.when(F.lower(plan).isin("pay_as_you_go", "pay-as-you-go"), "payg").otherwise(plan)


def clear_self_referrals(profiles: DataFrame) -> DataFrame:
    """A profile cannot have referred itself."""
    own = F.col("referred_by_user_id") == F.col("id")
    return profiles.withColumn(
        "referred_by_user_id", F.when(~F.coalesce(own, F.lit(False)), F.col("referred_by_user_id"))
    )


def drop_self_attributions(attributions: DataFrame) -> DataFrame:
    return attributions.filter(F.col("referrer_user_id") != F.col("referee_user_id"))


def backfill_updated_at(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("updated_at", F.coalesce("updated_at", "created_at"))


def backfill_status(status: Column, words: Column) -> Column:
    """Attributions that already paid out count as completed."""
    stale = status.isNull() | status.isin("", "pending")
    return F.when((F.coalesce(words, F.lit(0)) > 0) & stale, "completed").otherwise(status)


def _violation(table: str, rule: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(table).alias("table"), F.lit(rule).alias("rule"), "violations"
    )


def unique_violations(table: str, df: DataFrame, columns: list[str]) -> DataFrame:
    """Key values held by more than one row (nulls do not clash)."""
    keyed = df.filter(" AND ".join(f"{c} IS NOT NULL" for c in columns))
    repeated = keyed.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return _violation(table, f"unique({', '.join(columns)})", repeated)


def check_violations(table: str, df: DataFrame, name: str, holds: Column) -> DataFrame:
    """Rows for which the check is false (unknown passes, as in SQL)."""
    return _violation(table, f"check({name})", df.filter(~holds))


def null_violations(table: str, df: DataFrame, column: str) -> DataFrame:
    return _violation(table, f"not_null({column})", df.filter(F.col(column).isNull()))


def orphan_violations(table: str, df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows pointing at no parent."""
    refs = df.filter(F.col(column).isNotNull())
    lost = refs.join(parent.select(F.col(key).alias(column)), column, "left_anti")
    return _violation(table, f"foreign_key({column})", lost)


def constraint_report(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def upsert_profiles(profiles: DataFrame, signups: DataFrame) -> DataFrame:
    """Newest sign-up values win unless missing; blank names count as missing."""
    def named(c: str) -> Column:
        return F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))

    new = signups.select("id", F.col("email").alias("_email"), named("first_name").alias("_first"),
                         named("last_name").alias("_last"))
    return profiles.join(new, "id", "full").select(
        "id", F.coalesce("_email", "email").alias("email"),
        F.coalesce("_first", "first_name").alias("first_name"),
        F.coalesce("_last", "last_name").alias("last_name"),
    )
