"""Archive revisits, mixtures, personal data, neighbours, and the registered queries."""

from __future__ import annotations

import datetime
import os
import random
import re

import duckdb
import numpy as np
import pytest
from conftest import SF_DIR
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirework.llm import mixing, pii
from quirework.llm.ann import nearest
from quirework.llm.queries import QUERIES
from quirework.llm.warc import canonical_url, resolve_revisits

# ---- revisits --------------------------------------------------------------------------------------
RECORD = "record_id bigint, type string, url string, date timestamp, status int, headers map<string,string>, payload_digest string, outcome string"


def at(hour):
    return datetime.datetime(2024, 3, 1) + datetime.timedelta(hours=hour)


def test_canonical_urls(spark):
    urls = ["HTTP://WWW.Ex.com:80/a/?b=2&a=1&utm_source=q#f", "https://ex.com/a?a=1&b=2", "ex.com", "ex.com/", "", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    got = [r.u for r in df.withColumn("u", canonical_url(F.col("url"))).orderBy("i").collect()]
    assert got == ["ex.com/a?a=1&b=2", "ex.com/a?a=1&b=2", "ex.com", "ex.com", "", None]


def test_revisits(spark):
    rows = [
        (1, "response", "http://x.org/p", at(1), 200, {"ETag": '"a"', "Content-Type": "t", "Cache-Control": "old"}, "d1", "?"),
        (2, "response", "http://x.org/p", at(2), 404, {"ETag": '"a"'}, "d2", "?"),
        (3, "response", "http://x.org/p#q", at(50), 200, {"etag": '"b"', "Last-Modified": "L"}, "d3", "?"),
        (4, "response", "http://x.org/p", at(50), 200, {"etag": '"c"', "last-modified": "L"}, "d4", "?"),
        (10, "revisit", "https://www.x.org/p/", at(3), 304, {"ETAG": 'W/"a"', "cache-control": "new", "Content-Length": "0"}, None, "?"),
        (11, "revisit", "x.org/p", at(50), 304, {"etag": '"b"'}, None, "?"),
        (12, "revisit", "x.org/p", at(51), 304, {"last-modified": "L"}, None, "?"),
        (13, "revisit", "x.org/p", at(52), 304, {"X": "y", "etag": None}, None, "?"),
        (14, "revisit", "x.org/p", at(1), 304, None, None, "?"),
        (15, "revisit", None, at(60), 304, {}, None, "?"), (16, "revisit", "x.org/p", None, 304, {}, None, "?"),
        (17, "revisit", "x.org/p", at(53), 304, {"ETag": '"c"', "etag": '"z"'}, None, "?"), (17, "revisit", "x.org/p", at(53), 304, {"ETag": '"c"', "etag": '"z"'}, None, "?"),
    ]
    got = resolve_revisits(spark.createDataFrame(rows, RECORD)).collect()
    told = {r.record_id: r for r in got}
    assert len(got) == 9
    assert {i: (r.outcome, r.original_id) for i, r in told.items()} == {
        10: ("resolved", 1), 11: ("changed", 1), 12: ("resolved", 4), 13: ("no_validator", 4), 14: ("no_earlier", None),
        15: ("no_earlier", None), 16: ("no_earlier", None), 17: ("resolved", 4)}
    assert told[10].headers == {"etag": 'W/"a"', "content-type": "t", "cache-control": "new"} and told[10].payload_digest == "d1"
    assert told[11].payload_digest is None
    assert resolve_revisits(spark.createDataFrame([], RECORD)).count() == 0


# ---- mixing ----------------------------------------------------------------------------------------
@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=9))
def test_period_keeps_every_window(weights):
    order, q = mixing.period(weights), sum(weights)
    seen = [0] * len(weights)
    for slot, s in enumerate(order):
        i = seen[s]
        assert i * q // weights[s] <= slot < -(-(i + 1) * q // weights[s])
        seen[s] += 1
        assert all(abs(n * q - w * (slot + 1)) < q for n, w in zip(seen, weights))
    assert seen == weights


def brute_mixture(weights, blocks):
    """Slot by slot: earliest deadline among released blocks, anew whenever a source runs out."""
    left, start, out = dict(blocks), 0, []
    base = {s: 0 for s in blocks}
    while any(left.values()):
        live = [s for s in sorted(left) if left[s]]
        q, done, slot = sum(weights[s] for s in live), {s: 0 for s in live}, 0
        while all(left[s] for s in live):
            free = [s for s in live if done[s] * q // weights[s] <= slot]
            s = min(free, key=lambda s: (-(-(done[s] + 1) * q // weights[s]), -weights[s], s))
            out.append((s, base[s]))
            done[s] += 1
            base[s] += 1
            left[s] -= 1
            slot += 1
        start += slot
    return out


def test_mixture_against_slot_by_slot(spark):
    rnd = random.Random(5)
    rows = [(i, f"t{i}", rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(400)] + [(None, "n", "b")] * 3 + [(7, "t7", "a")]
    weights = {"a": 6, "b": 3, "c": 2, "": 4}
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id bigint, text string, source string, _slot string")
    got = mixing.mix_sources(df, weights, block_rows=7).collect()
    assert len(got) == len(rows) and sorted(r._position for r in got) == list(range(len(rows)))
    count = {s: sum((r[2] or "") == s for r in rows) for s in weights}
    want = brute_mixture(weights, {s: -(-n // 7) for s, n in count.items()})
    slots = sorted({(r._slot, r.source or "", r._block) for r in got})
    assert [s for s, _, _ in slots] == list(range(len(want))) and [(s, b) for _, s, b in slots] == want
    assert all(r._release <= r._slot < r._deadline for r in got)
    again = mixing.mix_sources(df.repartition(5), weights, block_rows=7).collect()
    key = lambda r: (r._position, r.source or "", r.doc_id or -1)
    assert sorted(map(key, got)) == sorted(map(key, again))
    ordered = mixing.in_mixed_order(mixing.mix_sources(df, weights, block_rows=7)).collect()
    assert [r._position for r in ordered] == list(range(len(rows)))


def test_mixture_edges(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.mix_sources(none).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id bigint, text string, source string")
    assert [r._position for r in mixing.mix_sources(one).collect()] == [0]
    with pytest.raises(ValueError):
        mixing.mix_sources(one, {"x": 1})


# ---- personal data ---------------------------------------------------------------------------------
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_forms(text):
    out = []
    for k, kind in enumerate(BASE):
        for m in re.finditer(BASE[kind], text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            if kind == "card":
                total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
                if not 16 <= len(digits) <= 19 or total % 10:
                    continue
            out.append((k, m.start(), m.end()))
    return out


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.sampled_from("a1.@+-_ 0249()%é\n"), max_size=60))
def test_fixed_forms(text):
    assert pii.fixed_forms(text) == brute_forms(text)


def test_fixed_forms_known_and_long():
    text = "x@y.co a@b@c.de 4111 1111 1111 1111, 10.0.0.256 1.2.3.4.5 +1 (728) 555-9388"
    assert pii.fixed_forms(text) == brute_forms(text) and len(pii.fixed_forms(text)) == 5
    for long in ("1" * 200_000, "a" * 200_000 + "@", "999." * 100_000, "+1" + "(" * 100_000, "@" * 100_000):
        assert pii.fixed_forms(long) == []


def test_learned_identifiers(spark):
    rows = [(i, f"please contact agent at user{i}@mail.example.org today") for i in range(12)]
    rows += [(100, "please contact agent at user77#mail#example today"), (101, "room 77 is free"), (102, None), (103, ""), (None, "mail a1@b.cd"), (101, "room 77 is free")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, mentions int")
    got = {}
    for r in pii.find_personal_data(df).collect():
        got.setdefault(r.doc_id, []).append((r.base, r.learned))
    assert [tuple(s) for s in got[100][0][1]] == [(0, 24, 43)]
    assert got[101] == [([], []), ([], [])] and got[102] == got[103] == [([], [])]
    assert len(got[None]) == 1 and [tuple(s) for s in got[None][0][0]] == [(0, 5, 12)]
    assert all(len(got[i][0][0]) == 1 for i in range(12))
    assert pii.find_personal_data(df.limit(0)).count() == 0


# ---- neighbours ------------------------------------------------------------------------------------
def brute_nearest(ids, x, queries, k):
    out = {}
    for i in queries:
        d = np.sqrt(((x - x[ids.index(i)]) ** 2).sum(1))
        out[i] = [(j, s) for s, j in sorted((s, j) for s, j in zip(d, ids) if j != i)[:k]]
    return out


def test_recall_of_the_index(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=np.float64)
    want = brute_nearest(ids, x, [i for i in ids if i % 20 == 0], 10)
    got = nearest(df, df.filter("vec_id % 20 = 0")).collect()
    assert len(got) == 10 * len(want)
    exact = {(q, j): s for q, near in want.items() for j, s in near}
    hits = [exact[r.query_id, r.vec_id] for r in got if (r.query_id, r.vec_id) in exact]
    assert len(hits) / len(exact) >= 0.9
    assert all(r.score == exact.get((r.query_id, r.vec_id), r.score) for r in got)


def test_neighbours_edges(spark):
    rows = [(0, [0.0, 0.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [1.0, 1.0]), (5, [1.0, 1.0]), (6, [1.0, 2.0]), (7, [3.0, 1.0, 1.0]), (None, [1.0, 1.0]), (8, [float("inf"), 0.0]), (9, [])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id bigint, embedding array<double>, rank int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df, df, k=3).collect())
    assert got == [(4, 1, 5, 0.0), (4, 2, 6, 1.0), (5, 1, 4, 0.0), (5, 2, 6, 1.0), (6, 1, 4, 1.0), (6, 2, 5, 1.0)]
    assert nearest(df.limit(0), df).count() == 0
    shards = nearest(df, df, k=3, shard_rows=1, block_rows=1)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in shards.collect()) == got


# ---- queries ---------------------------------------------------------------------------------------
def plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{f}'")
    df = QUERIES[name].build(spark, SF_DIR)
    cols = sorted(df.columns)
    cur = con.execute(QUERIES[name].sql)
    place = {c[0]: i for i, c in enumerate(cur.description)}
    assert sorted(place) == cols
    want = sorted((tuple(plain(r[place[c]]) for c in cols) for r in cur.fetchall()), key=str)
    assert sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=str) == want


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if not q.sql))
def test_queries_cover_their_table(spark, name):
    df = QUERIES[name].build(spark, SF_DIR)
    if name.startswith("op9"):
        n = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").filter("vec_id % 100 = 0").count() * 10
    else:
        n = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert df.count() == n
