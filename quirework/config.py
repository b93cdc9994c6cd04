"""Thresholds shared by the operators, with their published defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # segmenting and packing
    chunk_min_tokens: int = 500
    chunk_max_tokens: int = 5500
    min_translate_tokens: int = 12
    api_word_ratio_max: float = 1.0
    segment_overhead_tokens: int = 80
    queue_min_tokens: int = 300
    queue_max_tokens: int = 4200
    queue_min_words: int = 3500
    queue_max_words: int = 12_000
    request_max_input_tokens: int = 24_000
    request_prompt_reserve_tokens: int = 1400
    request_max_segments: int = 32
    max_completion_tokens: int = 16_384
    max_tokens_per_job: int = 400_000
    # previews
    preview_max_pages: int = 3
    preview_words_per_page: int = 260
    preview_max_words: int = 450
    preview_starts_per_day: int = 5
    # billing
    payg_rate_per_100k: float = 99.0
    minimum_charge: float = 5.0
    rate_per_10k_words: float = 9.9
    free_credits_initial: int = 10_000
    subscription_pool_words: int = 2_000_000
    subscription_period_days: int = 30
    subscription_year_days: int = 365
    # referrals
    signup_bonus_words: int = 10_000
    verify_reward_words: int = 3_000
    payment_reward_words: int = 7_000
    max_rewarded_referrals: int = 10
    max_words_per_referrer: int = 100_000
    # jobs
    max_processing_attempts: int = 3
    chunk_task_max_retries: int = 3
    cleanup_ttl_minutes: int = 45
    slow_request_seconds: float = 3.0
    daily_jobs_free: int = 20
    daily_jobs_paid: int = 2000
    max_queue_depth: int = 10_000
    chunk_queue_max_messages: int = 100_000
    requests_per_minute: int = 60
    memory_ttl_days: int = 7
    memory_model: str = "gpt-4o-mini"
    memory_temperature: float = 0.0
    default_target: str = "hinglish"
    max_upload_bytes: int = 100 * 1024 * 1024


DEFAULTS = Settings()
