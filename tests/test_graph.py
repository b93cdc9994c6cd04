"""Components in rounds, and claims in the order that components leave to them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quirework.operators import graph as G
from quirework.operators import referral as R


def _same(found: dict, edges: list[tuple[int, int]]) -> None:
    up: dict[int, int] = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(top(a), top(b))] = min(top(a), top(b))
    names: dict = {}
    assert set(found) == set(up)
    for node, name in found.items():
        assert names.setdefault(top(node), name) == name
    assert len(set(names.values())) == len(names)


@pytest.mark.parametrize("task_edges", [10_000, 150, 20])
def test_components(spark, task_edges):
    draw = random.Random(4)
    edges = [(i, i + 1) for i in range(1000, 1400)] + [(7, 2000 + i) for i in range(300)] + [(draw.randrange(3000, 3400), draw.randrange(3000, 3400)) for _ in range(250)]
    edges = [e for e in edges if e[0] != e[1]] * 2
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    _same({r.node: r.component for r in G.components(df, task_edges=task_edges).collect()}, edges)


def _plain(claims):
    referees, devices, won = set(), set(), set()
    for c, r, d, _ in sorted(claims, key=lambda c: (c[3], c[0])):
        if r not in referees and (d is None or d not in devices):
            referees.add(r)
            won.add(c)
            devices |= {d} - {None}
    return won


def _won(spark, claims):
    df = spark.createDataFrame(claims, "claim_id bigint, referee_id bigint, device string, at bigint")
    return {r.claim_id for r in R._credited(df.withColumn("claimed_at", F.timestamp_seconds("at"))).collect()}


def test_a_chain_of_a_thousand_claims(spark):
    """Each claim but the first shares a referee or a device with the one before it."""
    claims = [(i, i // 2, f"device-{(i + 1) // 2}", 1000 + i) for i in range(1000)]
    assert _won(spark, claims) == _plain(claims) == set(range(0, 1000, 2))


@pytest.mark.parametrize("fold", [200_000, 40])
def test_claims_equal_a_walk_in_order(spark, monkeypatch, fold):
    monkeypatch.setattr(R, "_FOLD_CLAIMS", fold)
    draw = random.Random(9)
    hot = [(i, i, "everyone", draw.randrange(50)) for i in range(300)]
    mixed = [(1000 + i, 5000 + draw.randrange(120), draw.choice([None, *[f"d{k}" for k in range(90)]]), draw.randrange(200)) for i in range(400)]
    lone = [(3000 + i, 9000 + i, f"own{i}", 1) for i in range(20)] + [(4000, 9500, None, 3), (4001, 9500, None, 2)]
    claims = hot + mixed + lone
    assert _won(spark, claims) == _plain(claims)
