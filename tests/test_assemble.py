from __future__ import annotations

import random

from conftest import SF_DIR
from pyspark.sql import functions as F

from quirework.operators import assemble as A
from quirework.operators.ordered import Sequence, neighbours, running
from quirework.plans import assembly_queries


def _rows(df):
    return df.orderBy("doc_id", "pos").collect()


def test_front_matter_and_nodes(blocks):
    df = blocks([
        {"text": "My **Novel**", "structural_tag": "title"}, {"text": "A. Writer", "structural_tag": "author"},
        {"text": "a tale", "semantic_role": "subtitle"}, {"text": "Row .... 3", "structural_tag": "toc", "action": "SKIP"},
        {"text": "left out", "action": "OMIT"}, {"type": "heading", "text": "Chapter 1", "semantic_role": "chapter"},
        {"text": "wrapped\nline\n\nstanza two"}, {"type": "list", "text": "1. one\n2. two", "list_kind": "ordered"},
        {"text": "“Said", "semantic_role": "quote"},
    ])
    d = A.structured_documents(A.nodes(df)).first()
    assert (d.title, d.subtitle, d.authors) == ("My Novel", "a tale", ["A. Writer"])
    assert [(c.type, c.text, c.kind, c.is_quote, c["items"]) for c in d.content] == [
        ("heading", "Chapter 1", "chapter", False, None), ("paragraph", "wrapped line\n\nstanza two", None, False, None),
        ("list", None, None, False, ["one", "two"]), ("paragraph", "“Said", None, True, None)]


def test_template_blocks(blocks):
    items = "1. 1.1 Alpha\n2. 1.2 Beta\n3. 1.3 Gamma"
    df = blocks([
        {"type": "heading", "text": "Part 1. The Enemies 4", "semantic_role": "chapter"},
        {"type": "heading", "text": "part 1. The Enemies", "semantic_role": "chapter"}, {"type": "list", "text": items, "list_kind": "ordered"},
        {"text": "Same."}, {"text": "Same."}, {"text": "Row ........ 35"}, {"text": "1.1 First title 1.2 Second title 1.3 Third title"},
        {"type": "heading", "text": "Introduction", "level": 2, "semantic_role": "heading"},
        {"type": "heading", "text": "Scope", "level": 3, "semantic_role": "subheading"},
    ])
    out = _rows(A.template_blocks(A.nodes(df)))
    assert [(r.type, r.text, r.chapter_start, r.is_subheading, r.h_level, r.anchor) for r in out] == [
        ("heading", "Part 1. The Enemies", True, False, 2, "part-1-the-enemies"), ("paragraph", "Same.", False, False, None, None),
        ("list", None, False, False, None, None), ("heading", "Introduction", False, False, 3, "introduction"),
        ("heading", "Scope", False, True, 5, "scope")]
    assert out[2]["items"][0] == "1.1 First title"


def test_anchor_clashes(blocks):
    df = blocks([{"text": t} for t in ("x", "x-2", "x", "x", "??")])
    assert [r.anchor for r in _rows(A.unique_anchors(df))] == ["x", "x-2", "x-3", "x-4", "section"]


def test_chapter_views(spark):
    rows = [("heading", "1", True), ("heading", "The Beginning", False), ("paragraph", "text", False), ("heading", "The Shears of", True),
            ("heading", "Revision", True), ("heading", "Chapter IV — Late", True), ("paragraph", "end", False)]
    df = spark.createDataFrame([(1, i, *r, False) for i, r in enumerate(rows)],
                               "doc_id bigint, pos int, type string, text string, chapter_start boolean, is_subheading boolean")
    assert [(r.text, r.chapter_no, r.display_text) for r in _rows(A.chapter_view(df))] == [
        ("1 The Beginning", "1", "The Beginning"), ("text", None, None),
        ("The Shears of Revision Chapter IV — Late", None, "The Shears of Revision Late"), ("end", None, None)]


def test_template_view_choice(spark):
    schema = ("doc_id int, chapters array<struct<title:string,headings:array<struct<text:string,level:int>>,paragraphs:array<string>,"
              "lists:array<struct<items:array<string>,ordered:boolean>>>>, "
              "blocks array<struct<type:string,text:string,level:int,items:array<string>,ordered:boolean>>, "
              "headings array<struct<text:string,level:int>>, paragraphs array<string>, lists array<struct<items:array<string>,ordered:boolean>>")
    empty = [("t", [], [], [])]
    rows = [(1, [("t", [], ["p"], [])], None, None, None, None), (2, empty, [("paragraph", "b", None, None, None)], None, None, None),
            (3, None, None, [("h", None)], ["p"], [(["i"], True)])]
    out = A.template_view(spark.createDataFrame(rows, schema)).orderBy("doc_id").collect()
    assert [r.use_chapters for r in out] == [True, False, False]
    assert [[b.type for b in r.blocks] for r in out] == [[], ["paragraph"], ["heading", "paragraph", "list"]]


def test_chunked_windows_cross_borders(spark):
    rng = random.Random(1)
    rows = [(k, p, rng.randint(-5, 5), rng.choice([None, p])) for k in range(3) for p in sorted(rng.sample(range(100), 40))]
    df = spark.createDataFrame(rows, "k int, p int, v int, s int")
    seq = Sequence(("k",), ("p",), "p div 7")
    got = {(r.k, r.p): r for r in running(df, seq, {"c": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("s"))}).collect()}
    near = {(r.k, r.p): (r.b, r.a) for r in neighbours(df, seq, {"b": F.col("p")}, {"a": F.col("p")}).collect()}
    for k in range(3):
        mine = [r for r in rows if r[0] == k]
        for i, r in enumerate(mine):
            seen = mine[: i + 1]
            g = got[(k, r[1])]
            assert (g.c, g.m) == (sum(x[2] for x in seen), max(x[2] for x in seen))
            assert g.l == next((x[3] for x in reversed(seen) if x[3] is not None), None)
            assert near[(k, r[1])] == (mine[i - 1][1] if i else None, mine[i + 1][1] if i + 1 < len(mine) else None)


def test_table_cells_hold_whole_texts(spark):
    """The table path runs over all words of a text, not over its first ones."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}
    rows = assembly_queries._with_tables(spark, SF_DIR).filter("type = 'table'").select("doc_id", "data").collect()
    assert {r.doc_id: len(r.data[1][0].split()) for r in rows} == {i: len((t or "").split()) for i, t in docs.items()}
