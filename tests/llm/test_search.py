"""Ranked search and exact nearest products against their SQL and against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from quirework.llm import search, topk
from quirework.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in re.findall(search.TERM, text or "")]


def plain(docs, items, k):
    counts = [(d, Counter(terms(t))) for d, t in docs if d is not None]
    counts = [(d, c) for d, c in counts if c]
    n, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked: dict[int, set] = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in asked.items():
        scores = []
        for d, c in counts:
            m = 50 + 50 * c.total() * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                scores.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()))


@pytest.mark.parametrize("name", ["op12_lexical_search", "op13_exact_search"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    cur = con.execute(QUERIES[name].sql)
    want = [tuple(r) for r in cur.fetchall()]
    have = QUERIES[name].build(spark, SF_DIR)
    assert have.columns == [c[0] for c in cur.description]
    assert sorted(map(tuple, have.collect())) == sorted(want) and want


def test_search_over_many_shards(spark):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Straße", "東京", "a1", "B"]
    odds = [1 / (i + 1) for i in range(len(words))]
    docs = [(i % 900, " ".join(draw.choices(words, odds, k=draw.choice((1, 5, 40, 400))))) for i in range(1500)]
    docs += [(5, docs[5][1])] * 300 + [(None, "w1 w2"), (2000, None), (2001, ""), (2002, "... --"), (2003, "B " * 5000)]
    items = [(i, " ".join(draw.choices(words, k=8))) for i in range(30)] + [(7, "w59"), (31, None), (32, ""), (None, "w1"), (33, "absent"), (34, "w0")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("score", "shard", "term")})
    asked = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(9))
    want = plain(docs, items, 10)
    assert got(search.ranked_search(frame, asked, k=10, shard_rows=100)) == want
    assert got(search.ranked_search(frame, asked, k=10)) == want
    assert got(search.ranked_search(frame.limit(0), asked)) == [] == got(search.ranked_search(frame, asked.limit(0)))


def test_all_terms_indexed_and_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "_VOCABULARY", 2)
    monkeypatch.setattr(search, "_QUERIES", 2)
    docs = [(i, f"x{i % 7} y{i % 5} z " * (i % 4 + 1)) for i in range(200)]
    items = [(i, f"x{i} y{i} z") for i in range(7)]
    have = search.ranked_search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), k=5)
    assert got(have) == plain(docs, items, 5)


def test_blocks_stay_compressed():
    """Rare terms lead: of the frequent term's blocks only those that may hold a better document are opened."""
    shard = search._Shard()
    for i in range(8000):
        shard.add(i, "common " * (1 + i % 3) + ("rare " * 9 if i in (10, 11, 12, 4000) else "") + "filler " * (i % 11), None)
    row = shard.row(0)
    index = search._Index(row, row["n_docs"], row["n_terms"])
    docs, scores = index.best(["common", "rare"], [3, 8000], 3)
    full = search._Index(row, row["n_docs"], row["n_terms"])
    every, all_scores = full.best(["common", "rare"], [3, 8000], 8000)
    assert docs.tolist() == every[:3].tolist() and scores.tolist() == all_scores[:3].tolist()
    assert index.unpacked < full.unpacked / 2
    assert len(row["body"]) < 2.5 * (np.frombuffer(row["dfs"], dtype=np.int64).sum())


# ---- exact nearest products --------------------------------------------------------------------------
def products(data, queries, k, scale=64):
    sure = lambda v: v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)
    data = [(i, v) for i, v in data if i is not None and sure(v)]
    most = Counter(len(v) for _, v in data)
    dim = max(most, key=lambda n: (most[n], n))
    whole = lambda v: [math.floor(scale * x) for x in v]
    data = [(i, whole(v)) for i, v in data if len(v) == dim]
    queries = {(i, tuple(whole(v))) for i, v in queries if i is not None and sure(v) and len(v) == dim}
    out = []
    for qi, q in queries:
        scores = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in data if i != qi)[:k]
        out += [(qi, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def found(data, queries, **more):
    return sorted(map(tuple, topk.nearest_products(data, queries, **more).collect()))


def test_products_with_clusters_ties_and_odd_vectors(spark):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(12, 8)) * 3
    data = [(i, (centres[i % 12] * (1 + i % 3) + 0.05 * draw.normal(size=8)).tolist()) for i in range(900)]
    data += [(1000 + i % 150, [0.5] * 8) for i in range(400)] + [(3000 + i, [0.0] * 8) for i in range(5)]
    odd = [(None, [1.0] * 8), (2000, None), (2001, []), (2002, [1.0] * 7), (2003, [float("nan")] * 8), (2004, [None, *[1.0] * 7]), (2005, [float("inf")] * 8), (40, [1.0] * 8), (40, data[40][1])]
    data += odd
    frame = spark.createDataFrame(data, "vec_id bigint, embedding array<float>").withColumns({c: F.lit(0) for c in ("v", "cell", "rank", "g")})
    held = [(r.vec_id, r.embedding) for r in frame.collect()]
    asked = [r for r in held if r[0] is not None and r[0] % 20 == 0]
    want = products(held, asked, 7)
    queries = frame.filter("vec_id % 20 = 0")
    assert found(frame, queries, k=7, group_queries=10, shard_rows=100, n_pivots=16) == want
    assert found(frame, queries, k=7) == want
    assert found(frame, queries, k=5000) == products(held, asked, 5000)
    assert found(frame.limit(0), queries) == [] == found(frame, queries.limit(0))


def test_large_components(spark):
    draw = np.random.default_rng(6)
    data = [(i, (draw.normal(size=4) * 1e6).tolist()) for i in range(120)]
    frame = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    assert found(frame, frame.filter("vec_id % 20 = 0"), k=5) == products(data, [d for d in data if d[0] % 20 == 0], 5)
    with pytest.raises(ValueError, match="products"):
        big = spark.createDataFrame([(1, [1e12]), (20, [2.0])], "vec_id bigint, embedding array<double>")
        topk.nearest_products(big, big)


def test_bounds_spare_far_clusters():
    """With clusters, a group of queries reaches few cells."""
    draw = np.random.default_rng(7)
    centres = draw.normal(size=(6, 4)) * 100
    between = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))
    near = {j: [(0.1 * i, 100 * j + i) for i in range(6)] for j in range(6)}
    for c in range(6):
        assert topk.reach(1.0, between[c], near, 5) == pytest.approx(1.4)
        assert topk.reach(1.0, between[c], near, 99) == float("inf")
    groups = topk.grouped({c: 10 for c in range(6)}, between, 20)
    assert sorted(sum(groups, [])) == list(range(6)) and all(len(g) == 2 for g in groups)
