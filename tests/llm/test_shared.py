"""Connected components, and counts of keys dealt over chunks."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quirework.llm import keycount, shared


@pytest.mark.parametrize("bound", [500_000, 40])
def test_components(spark, monkeypatch, bound):
    monkeypatch.setattr(shared, "_TASK_EDGES", bound)
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 7), (9, 8), (8, 9)] + [(200, 200 + i) for i in range(1, 50)]
    edges += [(rnd.randrange(300, 330), rnd.randrange(300, 330)) for _ in range(60)]
    up = {n: n for n in range(400)}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    nodes = spark.range(400).withColumnRenamed("id", "node")
    got = shared.components(nodes, spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == {n: top(n) for n in up} and len(got) == 400
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert all(r.node == r.component for r in shared.components(nodes, none).collect())


def test_counts_pack():
    counts = np.array([0, 1, 254, 255, 256, 2**40, 3], dtype=np.uint64)
    assert keycount.unpack(keycount.pack(counts), len(counts)).tolist() == counts.tolist()
    assert keycount.unpack(keycount.pack(counts[:0]), 0).tolist() == []
