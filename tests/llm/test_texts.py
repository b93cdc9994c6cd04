"""Operators on texts: language-model scores, near copies, exact copies, repeated lines."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirework.llm import ngram_join
from quirework.llm.exact_dedup import content_sort
from quirework.llm.line_dedup import remove_repeated_windows
from quirework.llm.lm_score import entropy_difference
from quirework.llm.ngram_join import jaccard_join

SCHEMA = "doc_id bigint, text string, lang string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def table(spark, rows, schema=SCHEMA):
    width = len(schema.split(","))
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


def words(text):
    return [w.translate(LOWER) for w in WORD.findall(text or "")]


def long_texts():
    base = [f"w{i}" for i in range(200)]
    out = []
    for k in range(24):
        changed = list(base)
        for j in range(k % 6):
            changed[(k * 17 + j * 31) % 200] = f"x{k}_{j}"
        out.append((100 + k, " ".join(changed)))
    common = " ".join(f"c{i}" for i in range(30))
    out += [(200 + k, common + " " + " ".join(f"y{k}_{i}" for i in range(40))) for k in range(20)]
    return out


EDGES = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one  TWO"), (8, "two one"),
    (None, "one two"), (None, None), (9, "one two"), (9, "one two"), (10, "Ünë two three"), (11, "ünë two three"), (12, "x " * 30_000),
]


# ---- near copies -----------------------------------------------------------------------------------
def brute_components(rows, n, num, den):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets.setdefault(i, []).append(frozenset(tuple(w[k: k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    ids = [i for i in sets if i is not None]
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            for p in sets[a]:
                for q in sets[b]:
                    if a < b and p and q and den * len(p & q) >= num * len(p | q):
                        x, y = sorted((top(a), top(b)))
                        up[y] = x
    return sorted((i, len(s), top(i)) for i in ids for s in sets[i])


@pytest.mark.parametrize("n, num, den", [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
def test_near_copies_against_all_pairs(spark, n, num, den):
    rows = EDGES + long_texts()
    docs, links = jaccard_join(table(spark, rows), n=n, num=num, den=den)
    got = docs.collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == brute_components(rows, n, num, den)
    assert [(r.component_id, r.n_links) for r in got if r.doc_id is None] == [(None, 0)] * 2
    for r in links.collect():
        assert r.a < r.b and r.common > 0


def brute_links(rows, n, num, den):
    """Per (doc_id, size) of the class's smallest doc_id its links, and all pairs of similar classes."""
    classes = {}
    for i, t in rows:
        w = words(t)
        if i is not None and w:
            s = frozenset(tuple(w[k: k + n]) for k in range(max(1, len(w) - n + 1)))
            classes[s] = min(classes.get(s, i), i)
    named, pairs = [(i, s) for s, i in classes.items()], []
    degree = Counter()
    for x, (a, p) in enumerate(named):
        for b, q in named[x + 1:]:
            if den * len(p & q) >= num * len(p | q):
                degree[p] += 1
                degree[q] += 1
                pairs.append((min(a, b), max(a, b), len(p & q)))
    return {(i, s): degree[s] for s, i in classes.items()}, sorted(pairs)


@pytest.mark.parametrize("n, num, den", [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
@pytest.mark.parametrize("span, often", [(1000, 48), (7, 3)])
def test_all_links_against_all_pairs(spark, monkeypatch, n, num, den, span, often):
    monkeypatch.setattr(ngram_join, "_SPAN_ROWS", span)
    monkeypatch.setattr(ngram_join, "_OFTEN", often)
    near = [" ".join(f"w{i}" if i != k else "changed" for i in range(200)) for k in range(0, 200, 3)]
    rows = EDGES + long_texts() + [(300 + k, t) for k, t in enumerate(near)] + [(300, near[0]), (300, near[5]), (299, near[7])]
    docs, links = jaccard_join(table(spark, rows), n=n, num=num, den=den)
    degree, pairs = brute_links(rows, n, num, den)
    assert sorted((r.a, r.b, r.common) for r in links.collect()) == pairs
    want = []
    for i, t in rows:
        w = words(t)
        s = frozenset(tuple(w[k: k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
        want.append((str(i), len(s), sum(d for (_, q), d in degree.items() if q == s) if i is not None else 0))
    assert sorted((str(r.doc_id), r.n_shingles, r.n_links) for r in docs.collect()) == sorted(want)


def test_near_copies_of_nothing(spark):
    docs, links = jaccard_join(table(spark, []))
    assert docs.count() == 0 and links.count() == 0
    docs, _ = jaccard_join(table(spark, [(1, None), (2, "")]))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in docs.collect()) == [(1, 0, 1), (2, 0, 2)]


# ---- exact copies ----------------------------------------------------------------------------------
@pytest.mark.parametrize("keep, pick", [("max", max), ("min", min)])
def test_exact_copies(spark, keep, pick):
    rows = [r for r in EDGES if r[0] is not None] + [(i, "hot copy") for i in range(1000, 1400)] + [(2000 + i, f"own {i}") for i in range(40)]
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    got = content_sort(table(spark, rows), keep=keep).collect()
    assert len(got) == len(rows)
    text = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    for r in got:
        members = groups[text[r.text_sha256]]
        assert (r.keep_id, r.group_size) == (pick(members), len(members))
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(groups)


def test_exact_copies_null_ids_and_empty_table(spark):
    got = content_sort(table(spark, [(None, "a"), (5, "a"), (None, "b"), (None, "b")])).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [
        (0, 0, 2, False), (0, 0, 2, True), (0, 5, 2, False), (5, 5, 2, True)]
    assert content_sort(table(spark, [])).count() == 0


# ---- repeated lines --------------------------------------------------------------------------------
def test_repeated_windows(spark):
    passage = "a a\nb b\n\n  c c \nd d"
    rows = [
        (1, f"head\n{passage}\ntail"), (2, f"{passage}\nother"), (3, "x\ny\nz"), (4, "x\ny"), (5, None), (6, ""), (7, "a a\nb b\nq"),
        (8, "r\nr\nr\nr\nr\nr"), (9, "one long line"), (9, "one long line"), (None, "n\nm\no\nlast"), (10, "n\nm\no"),
    ]
    got = {(r.doc_id, r.text): r for r in remove_repeated_windows(table(spark, rows)).collect()}
    assert len(got) == 11
    assert got[1, f"head\n{passage}\ntail"].n_removed == 0
    assert got[2, "other"].removed == [0, 1, 2, 3, 4] and got[2, "other"].n_lines == 6
    assert got[5, None].n_lines == 0 and got[6, ""].n_lines == 1
    assert got[7, "a a\nb b\nq"].n_removed == 0
    assert got[8, "r\nr\nr"].removed == [3, 4, 5]
    assert got[10, ""].removed == [0, 1, 2]
    assert got[None, "n\nm\no\nlast"].n_removed == 0


def test_repeated_windows_other_columns(spark):
    schema = "doc_id bigint, text string, _text string, n_lines string, _cuts string, `in` string"
    df = table(spark, [(1, "a\nb\nc", "t", "n", "c", "i"), (2, "a\nb\nc\nd", "t", "n", "c", "i")], schema)
    out = remove_repeated_windows(df)
    assert sorted(out.columns) == sorted(["doc_id", "text", "_text", "_cuts", "in", "n_lines", "n_removed", "removed"])
    assert sorted((r.doc_id, r.text, r._text, r["in"], r.n_lines) for r in out.collect()) == [(1, "a\nb\nc", "t", "i", 3), (2, "d", "t", "i", 4)]
    assert remove_repeated_windows(table(spark, [])).count() == 0


# ---- language models -------------------------------------------------------------------------------
def brute_difference(rows, target, pair_weight=4.0, single_weight=100.0):
    uni, bi = [Counter(), Counter()], [Counter(), Counter()]
    for i, t in rows:
        w = words(t)
        if w:
            m = 0 if i in target else 1
            uni[m].update([*w, ""])
            bi[m].update(zip(["", *w], [*w, ""]))
    n = [sum(c.values()) for c in uni]
    out = []
    for i, t in rows:
        w = words(t)
        total = 0.0
        for v, x in zip(["", *w], [*w, ""]) if w else []:
            share = (uni[0][x] + uni[1][x]) / sum(n)
            p = []
            for m in (0, 1):
                alone = (uni[m][x] + single_weight * share) / (n[m] + single_weight)
                p.append((bi[m][v, x] + pair_weight * alone) / (uni[m][v] + pair_weight))
            total += math.log(p[1]) - math.log(p[0])
        out.append((i is None, i or 0, len(w), round(total / (len(w) + 1), 9) if w else None))
    return sorted(out, key=str)


def test_entropy_difference(spark):
    rows = EDGES + long_texts()
    target = {4, 9, 100, 103, 205}
    marks = spark.createDataFrame([(i,) for i in [*target, 4, None]], "doc_id bigint")
    got = entropy_difference(table(spark, rows), marks).collect()
    assert sorted([(r.doc_id is None, r.doc_id or 0, r.n_words, None if r.difference is None else round(r.difference, 9)) for r in got], key=str) \
        == brute_difference(rows, target)
    assert entropy_difference(table(spark, []), marks).count() == 0
    assert entropy_difference(table(spark, [(1, None)]), marks).collect()[0].difference is None


def test_a_row_many_times_is_one_document(spark):
    """A hundred thousand equal rows have the windows of one."""
    text = "\n".join(f"line {i} of one text" for i in range(30))
    hot = spark.range(100_000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit(text).alias("text"))
    docs = hot.unionByName(table(spark, [(3, "\n".join(text.split("\n")[:12])), (9, text)]).select("doc_id", "text"))
    out = remove_repeated_windows(docs).groupBy("doc_id", "n_lines", "n_removed").count().collect()
    assert {tuple(r) for r in out} == {(3, 12, 0, 1), (7, 30, 12, 100_000), (9, 30, 30, 1)}
