"""Row types of the block tables and the relational tables, as DDL text for readers."""

from __future__ import annotations


_HINTS = (
    "struct<font_pt_max:double,bold_fraction:double,lines_merged:int,y0:double,y1:double,"
    "gap_before_pt:double,body_font_pt:double>"
)
BLOCKS = (
    "doc_id bigint, pos int, type string, text string, data array<array<string>>, level int, structural_tag string, "
    f"list_kind string, source_page int, semantic_role string, pdf_hints {_HINTS}"
)
LINES = (
    "doc_id bigint, page int, line_no int, x0 double, y0 double, x1 double, y1 double, "
    "spans array<struct<text:string,size:double,font:string,flags:int>>"
)
PROFILES = (
    "id bigint, email string, plan string, free_credits int, referral_bonus_words int, subscription_active boolean, "
    "subscription_credits int, subscription_started_at timestamp, subscription_period_start timestamp, "
    "subscription_contract_end timestamp, subscription_expiry timestamp, pending_kind string, subscription_id string, "
    "credits_balance decimal(12,2), referral_code string, referred_by_user_id bigint"
)
JOBS = (
    "id bigint, user_id bigint, status string, content_hash string, tokens_used bigint, cost decimal(10,2), "
    "processing_seconds double, created_at timestamp, completed_at timestamp, translation_attempt int"
)
USAGE = (
    "user_id bigint, job_id bigint, tokens_used bigint, cost decimal(12,4), created_at timestamp"
)
TRANSACTIONS = (
    "user_id bigint, amount decimal(12,4), provider string, external_id string, status string, kind string, "
    "order_id string, job_id bigint, created_at timestamp"
)
ATTRIBUTIONS = (
    "id bigint, referee_user_id bigint, referrer_user_id bigint, status string, device_hash string, "
    "words_credited_to_referrer int, created_at timestamp"
)
CREDITS = (
    "user_id bigint, type string, credits int, idempotency_key string, created_at timestamp"
)
USERS = ("id bigint, api_key_hash string, tier string, email string, created_at timestamp")
