"""Keyed state of the streaming operators: chunk counters, progress and subscriptions.

Each processor keeps its own variables in the state store (the RocksDB provider is needed), so no batch
reads a table of what was seen before, and a restarted query goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quirework.config import Settings

DAY_MS = 86_400_000
_DAY_S = 86_400


def _utc(at: pd.Timestamp) -> pd.Timestamp:
    return at.tz_localize("UTC") if at.tzinfo is None else at


class Kept(StatefulProcessor):
    """State that leaves when the watermark is ``keep_days`` past the newest row of its key."""

    def __init__(self, keep_days: int) -> None:
        self.keep_ms = keep_days * DAY_MS

    def keep(self, newest: pd.Timestamp, timerValues: object) -> None:
        at = max(int(newest.timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.keep_ms
        timers = list(self.handle.listTimers())
        if all(t < at for t in timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        for variable in self.variables:
            variable.clear()
        return iter(())


class Counters(Kept):
    """Outcomes per job, each batch and outcome once, and a trigger that fires once however often they come."""

    SCHEMA = "job_id string, done int, failed int, total int, finalize boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "batch_id bigint, outcome string", "ok boolean")
        self.counts = handle.getValueState("counts", "done int, failed int, total int, fired boolean")
        self.variables = self.seen, self.counts

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        done, failed, total, fired = self.counts.get() if self.counts.exists() else (0, 0, 0, False)
        newest = pd.Timestamp(0, tz="UTC")
        for pdf in rows:
            newest = max(newest, _utc(pdf["ts"].max()))
            total = max(total, int(pdf["total"].fillna(0).max()))
            for batch, outcome in pdf[["batch_id", "outcome"]].drop_duplicates().itertuples(index=False):
                if not self.seen.containsKey((int(batch), outcome)):
                    self.seen.updateValue((int(batch), outcome), (outcome == "ok",))
                    done, failed = done + (outcome == "ok"), failed + (outcome == "failed")
        final = total > 0 and done + failed >= total
        self.counts.update((done, failed, total, fired or final))
        self.keep(newest, timerValues)
        yield pd.DataFrame({"job_id": [key[0]], "done": [done], "failed": [failed], "total": [total], "finalize": [final and not fired]})


class Progress(Kept):
    """Percentages that never fall, but for a reset by "failed at 0"."""

    SCHEMA = "job_id string, event_id bigint, progress int, shown_stage string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shown = handle.getValueState("shown", "pct int, stage string")
        self.variables = (self.shown,)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        before, stage = self.shown.get() if self.shown.exists() else (0, None)
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"], ignore_index=True)
        new = pdf["pct"].clip(0, 100).astype("int32")
        reset = (pdf["stage"] == "failed") & (new == 0)
        era = reset.cumsum()
        pct = new.where(era > 0, np.maximum(new, before)).groupby(era).cummax()
        # The stage of the latest update that reached what is shown.
        shown = pdf["stage"].where(new >= pct).ffill().fillna(stage if stage is not None else pdf["stage"].iloc[0])
        self.shown.update((int(pct.iloc[-1]), shown.iloc[-1]))
        self.keep(_utc(pdf["ts"].iloc[-1]), timerValues)
        yield pd.DataFrame({"job_id": key[0], "event_id": pdf["event_id"], "progress": pct.astype("int32"), "shown_stage": shown})


def subscription_after(profile: tuple, changes: list[tuple], cfg: Settings) -> tuple:
    """B6 for one subscription: (active, plan, credits, contract end, expiry, period start), times in seconds.

    ``profile``: (kind, free words, expiry, contract end, period start); ``changes``: (order, action, at, end, start). What a
    change does depends only on the first deactivation and on the last monthly activation without an end.
    """
    kind, free, expiry, contract, begun = profile
    changes = sorted(changes)
    off = next((i for i, c in enumerate(changes) if c[1] != "activate"), len(changes))
    yearly = [c[1] == "activate" and i < off and kind == "yearly" for i, c in enumerate(changes)]
    monthly = [c[1] == "activate" and not y for c, y in zip(changes, yearly)]
    sets = max((i for i, (c, m) in enumerate(zip(changes, monthly)) if m and c[3] is None), default=-1)
    ends = [cfg.subscription_period_days * _DAY_S + c[2] if c[3] is None else c[3] for i, (c, m) in enumerate(zip(changes, monthly)) if m and i >= sets]
    years = [c[2] + cfg.subscription_year_days * _DAY_S if c[3] is None else c[3] for c, y in zip(changes, yearly) if y]
    most = lambda xs: max((x for x in xs if x is not None), default=None)
    contract = most([*years, contract]) if years else None
    starts = [c[2] if c[4] is None else c[4] for c, y, m in zip(changes, yearly, monthly) if y or m and c[4] is not None]
    first = next((c[2] if c[4] is None else c[4] for c in changes if c[1] == "activate"), None)
    active = changes[-1][1] == "activate"
    plan = ("yearly" if yearly[-1] else "monthly") if active else "payg" if (free or 0) <= 0 else "free"
    return (
        active, plan, cfg.subscription_pool_words if active else 0, contract if active and yearly[-1] else None,
        most(ends) if sets >= 0 else most([*ends, expiry, contract]), starts[-1] if starts else begun if begun is not None else first)


class Subscriptions(StatefulProcessor):
    """T4 + B6: the subscription behind each id, from its profile (the initial state) and its own ledger of notices.

    The ledger is a map in the state store by idempotency key, so a notice that comes again changes nothing and one that comes late
    takes its place in the order of receipt. The end of the paid time is a timer: when the watermark passes it, the row
    comes once more as lapsed, with no words left in the pool.
    """

    SCHEMA = (
        "user_id bigint, subscription_id string, subscription_active boolean, plan string, subscription_credits int, subscription_contract_end bigint, "
        "subscription_expiry bigint, subscription_period_start bigint, notices int, lapsed boolean")
    PROFILE = "user_id bigint, kind string, free int, expiry bigint, contract bigint, begun bigint"
    NOTICE = "at_us bigint, event_id bigint, action string, at bigint, ends bigint, begins bigint"

    def __init__(self, cfg: Settings) -> None:
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.profile = handle.getValueState("profile", self.PROFILE)
        self.ledger = handle.getMapState("ledger", "key string", self.NOTICE)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        row = initialState.iloc[0]
        self.profile.update(tuple(None if pd.isna(row[c]) else row[c] if c == "kind" else int(row[c]) for c in (f.split()[0] for f in self.PROFILE.split(", "))))

    def _state(self, key: tuple, lapsed: bool) -> pd.DataFrame:
        user, *profile = self.profile.get()
        changes = [((us, event), action, at, ends, begins) for us, event, action, at, ends, begins in self.ledger.values()]
        values = subscription_after(tuple(profile), changes, self.cfg)
        names = [f.split()[0] for f in self.SCHEMA.split(", ")]
        row = pd.DataFrame([[user, key[0], *values, len(changes), lapsed]], columns=names, dtype=object)
        if lapsed:
            row["subscription_credits"] = 0
        whole = {"user_id": "Int64", **{c: "Int64" for c in names[5:8]}, "subscription_credits": "int32", "notices": "int32"}
        return row.astype({**whole, "subscription_active": bool, "lapsed": bool})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        fresh = False
        for pdf in rows:
            for key_, *notice in pdf[["key", *[f.split()[0] for f in self.NOTICE.split(", ")]]].itertuples(index=False):
                one = tuple(None if pd.isna(x) else x if isinstance(x, str) else int(x) for x in notice)
                known = self.ledger.getValue((key_,))
                if self.profile.exists() and (known is None or one[:2] < tuple(known)[:2]):
                    self.ledger.updateValue((key_,), one)
                    fresh = True
        if fresh:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            out = self._state(key, False)
            end = out["subscription_expiry"].iloc[0]
            if out["subscription_active"].iloc[0] and not pd.isna(end):
                self.handle.registerTimer(max(int(end) * 1000, timerValues.getCurrentWatermarkInMs() + 1))
            yield out

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        yield self._state(key, True)
