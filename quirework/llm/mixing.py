"""Mixing sources to target weights by Pfair scheduling (operator 4).

Each source's rows form blocks. With weight w, block i of a source (from 0) is released at slot
floor(i / w) and due by slot ceil((i + 1) / w); in every slot the released block with the earliest
deadline goes. With integer weights of sum q the schedule repeats after q slots, so one period is all
that has to be worked out, and every row finds its slot from its block number alone.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.shared import partitions


def period(weights: list[int]) -> list[int]:
    """Which source each slot of one period goes to: weights[s] slots for source s.

    Of equal deadlines the larger weight goes first, then the earlier source.
    """
    total = sum(weights)
    waiting = [(0, s, 0) for s, w in enumerate(weights) if w]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // weights[s]), -weights[s], s, i))
        _, _, s, i = heapq.heappop(ready)
        out.append(s)
        if i + 1 < weights[s]:
            heapq.heappush(waiting, ((i + 1) * total // weights[s], s, i + 1))
    return out


def phases(weights: list[int], blocks: list[int]) -> list[tuple[int, list[int], list[int]]]:
    """(first slot, blocks taken before it, weights) of each phase.

    A phase ends with the slot in which a source runs out; the others then share by their weights.
    """
    start, taken, out = 0, [0] * len(weights), []
    while True:
        live = [w if t < b else 0 for w, t, b in zip(weights, taken, blocks, strict=True)]
        if not any(live):
            return out
        shared = math.gcd(*live)
        live = [w // shared for w in live]
        out.append((start, list(taken), live))
        slots: dict[int, list[int]] = {}
        for slot, s in enumerate(period(live)):
            slots.setdefault(s, []).append(slot)
        q = sum(live)

        def ends(s: int) -> int:
            """Slots of the phase up to and with the last block of source s."""
            last = blocks[s] - taken[s] - 1
            return last // live[s] * q + slots[s][last % live[s]] + 1

        length = min(ends(s) for s in slots)
        whole, rest = divmod(length, q)
        for s, at in slots.items():
            taken[s] += whole * live[s] + sum(x < rest for x in at)
        start += length


def tempered(counts: Mapping[str, int], alpha: float = 0.5, parts: int = 1000) -> dict[str, int]:
    """Integer weights in proportion to the counts' power ``alpha``, of about ``parts`` in all, 1 at least."""
    powers = {s: n**alpha for s, n in counts.items()}
    total = sum(powers.values())
    return {s: max(1, round(parts * p / total)) for s, p in powers.items()}


def mix_sources(docs: DataFrame, weights: Mapping[str, int] | None = None, *, block_rows: int = 16, seed: int = 42) -> DataFrame:
    """``docs`` with _block (its number in the source), _release and _deadline (slots), _slot and _position.

    _position counts all rows from 0 in mixed order: sorting by it gives the mixture. While all
    sources last, after any number of slots a source's blocks differ by less than one from its weight's
    share of the slots; when one runs out, the rest start again with their weights, until every row has a place.
    ``weights`` are positive integers by source and must name every source (null as ""); without
    them a source weighs as the square root of its rows. Inside a source rows go by a hash of ``seed``
    and doc_id, then by doc_id and text.

    A null source is the source "". Null and repeated doc_ids are ordered by their texts, and
    identical rows get places of their own in any order. Other columns pass through; those with one of the five names are replaced.
    An empty table gives an empty one. The driver sees one count per source; a source's rows are
    numbered in ranges of the hash, so a source with most of the rows is not one task's work.
    The weights that were taken are the metadata of _position.
    """
    made = ("_block", "_release", "_deadline", "_slot", "_position")
    docs = docs.drop(*[c for c in docs.columns if c in made])
    spark = docs.sparkSession
    source = F.coalesce("source", F.lit(""))
    counts = {r["s"]: r["n"] for r in docs.groupBy(source.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = dict(tempered(counts) if weights is None else weights)
    if missing := sorted(set(counts) - {s for s, w in weights.items() if w > 0}):
        raise ValueError(f"sources without a positive weight: {missing[:5]}")
    names = sorted(counts)
    plan = phases([weights[s] for s in names], [-(-counts[s] // block_rows) for s in names])

    # One row per phase, source and block of a period: bounded by the weights and the number of sources.
    table, last = [], {}
    for start, taken, live in plan:
        q, seen = sum(live), [0] * len(live)
        for slot, s in enumerate(period(live)):
            table.append((names[s], start, taken[s], live[s], q, seen[s], slot, seen[s] * q // live[s], -(-(seen[s] + 1) * q // live[s])))
            seen[s] += 1
    for i, s in enumerate(names):
        block = -(-counts[s] // block_rows) - 1
        start, taken, live = [p for p in plan if p[1][i] <= block and p[2][i]][-1]
        at = [x for x, y in enumerate(period(live)) if y == i]
        k = block - taken[i]
        last[s] = (start + k // live[i] * sum(live) + at[k % live[i]], (block + 1) * block_rows - counts[s])
    schedule = spark.createDataFrame(table, "_source string, _start bigint, _taken bigint, _w bigint, _q bigint, _k bigint, _at bigint, _r bigint, _d bigint")
    # A source's last block may be short; the slots behind it move up.
    short = sorted((slot, gap) for slot, gap in last.values() if gap)
    gaps = F.lit(0).cast("long")
    if short:
        pairs = F.array(*[F.struct(F.lit(a).cast("long").alias("slot"), F.lit(g).cast("long").alias("gap")) for a, g in short])
        gaps = F.aggregate(F.filter(pairs, lambda p: p["slot"] < F.col("_slot")), F.lit(0).cast("long"), lambda acc, p: acc + p["gap"])

    bits = max(4, math.ceil(math.log2(max(1, sum(counts.values()) / 20_000) * 64)))
    order = F.xxhash64(F.lit(seed), "doc_id")
    rows = docs.select(
        F.struct("*").alias("_in"), source.alias("_source"), order.alias("_hash"), F.shiftright(order, 64 - bits).alias("_range"),
        F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"))
    before = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("_source", "_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_source", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_source", "_range").orderBy("_hash", "_id", "_text")
    numbered = rows.withColumn("_i", F.row_number().over(inside) - 1).join(ranges, ["_source", "_range"])
    number = F.col("_before") + F.col("_i")
    phased = numbered.select("_in", "_source", number.alias("_row"), F.floor(number / block_rows).cast("long").alias("_block"))

    first = Window.partitionBy("_source").orderBy("_start")
    spans = schedule.filter("_k = 0").select("_source", "_start", "_taken", F.lead("_taken").over(first).alias("_until"), "_w")
    held = phased.join(F.broadcast(spans), "_source").filter("_block >= _taken AND (_until IS NULL OR _block < _until)")
    nth = F.col("_block") - F.col("_taken")
    held = held.withColumns({"_k": nth % F.col("_w"), "_turn": F.floor(nth / F.col("_w")).cast("long")})
    placed = held.join(F.broadcast(schedule.drop("_w", "_taken")), ["_source", "_start", "_k"])
    base = F.col("_start") + F.col("_turn") * F.col("_q")
    out = placed.withColumns({"_slot": base + F.col("_at"), "_release": base + F.col("_r"), "_deadline": base + F.col("_d")})
    out = out.withColumn("_position", F.col("_slot") * block_rows - gaps + F.col("_row") % block_rows)
    taken_weights = {s: weights[s] for s in names}
    return out.select("_in.*", *made[:-1], F.col("_position").alias("_position", metadata={"weights": taken_weights}))


def in_mixed_order(mixed: DataFrame) -> DataFrame:
    """Rows in the order of their position, range by range."""
    return mixed.repartitionByRange(partitions(mixed.sparkSession), "_position").sortWithinPartitions("_position")
