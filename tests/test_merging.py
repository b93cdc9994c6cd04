from __future__ import annotations

from conftest import column
from pyspark.sql import functions as F

from quirework.operators import merging as M
from quirework.operators import pages as PG


def _pages(*pairs):
    return [{"text": t, "source_page": p} for t, p in pairs]


def test_page_breaks(blocks):
    df = blocks(_pages(("From early morning I had been oppressed by a", 5), ("strange gloom. It was so.", 6), ("We stud-", 7),
                       ("ied the text", 8), ("on and on.", 9), ("NIGHTS .......... 4", 10), ("FIRST NIGHT it was", 11)))
    out = M.stitch_pages(df)
    assert column(out, "text") == [
        "From early morning I had been oppressed by a strange gloom. It was so.", "We studied the text on and on.",
        "NIGHTS .......... 4", "FIRST NIGHT it was"]
    assert column(out, "source_page") == [6, 9, 10, 11]


def test_shouts_go_back(blocks):
    df = blocks([
        {"text": "They say, 'STOP! THIS IS A", "source_page": 5},
        {"type": "heading", "text": "MOMENT WHEN YOU NEED TO THINK!'", "source_page": 5},
        {"type": "heading", "text": "AND THINK AGAIN NOW!", "source_page": 6},
        {"text": "The prior sentence ends.", "source_page": 6}, {"type": "heading", "text": "NO MORE OF THAT!", "source_page": 6},
    ])
    assert column(M.fold_caps_emphasis(df), "text") == [
        "They say, 'STOP! THIS IS A MOMENT WHEN YOU NEED TO THINK!'", "AND THINK AGAIN NOW!", "The prior sentence ends.",
        "NO MORE OF THAT!"]


def test_shards_and_labels(blocks):
    df = blocks([{"text": t} for t in ("The story goes", "on without end.", "A new one.", "and more", "Preface", "Body of it", "Chapter", "12",
                                       "goes on")])
    assert column(M.merge_shards(df), "text") == [
        "The story goes on without end.", "A new one. and more", "Preface", "Body of it Chapter 12 goes on"]
    alone = blocks([{"text": t} for t in ("Chapter", "12", "goes on")])
    assert column(M.merge_shards(alone), "text") == ["Chapter 12", "goes on"]


def test_merge_three_at_a_time(blocks):
    df = blocks([{"text": str(i)} for i in range(5)] + [{"type": "heading", "text": "h"}, {"text": "x"}])
    assert column(M.merge_adjacent(df), "text") == ["0\n\n1\n\n2", "3\n\n4", "h", "x"]


def test_repeated_page_heads(blocks):
    rows = [r for p in range(1, 9) for r in (
        {"text": "The  Running Head", "source_page": p}, {"text": f"body of page number {p} goes here", "source_page": p},
        {"text": f"- {p} -", "source_page": p})]
    left = column(PG.drop_repeated_fragments(blocks(rows)), "text")
    assert left == [f"body of page number {p} goes here" for p in range(1, 9)]
    two = blocks([{"text": "x", "source_page": 1}, {"text": "12", "source_page": 2}])
    assert PG.drop_repeated_fragments(two).count() == 2


def test_typed_runs(spark):
    def line(n, y, text, size=11.0, flags=0):
        return (1, 1, n, 0.0, y, 100.0, y + 10, [(text, size, "Serif", flags)])

    rows = [line(0, 0.0, "BIG TITLE", 20.0), line(1, 30.0, "body text that goes", 11.0), line(2, 42.0, "on here", 11.0),
            line(3, 80.0, "A bold run", 11.0, 16), line(4, 120.0, "1. an item", 11.0), line(5, 150.0, "more of the body", 11.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, page int, line_no int, x0 double, y0 double, x1 double, y1 double, "
                               "spans array<struct<text:string,size:double,font:string,flags:int>>")
    out = PG.page_blocks(df).orderBy("pos").collect()
    assert [(r["type"], r["text"], r["level"]) for r in out] == [
        ("heading", "BIG TITLE", 1), ("paragraph", "body text that goes on here", 1), ("heading", "A bold run", 2),
        ("list", "1. an item", 1), ("paragraph", "more of the body", 1)]
    assert out[1]["pdf_hints"]["gap_before_pt"] == 20.0 and out[4 - 1]["list_kind"] == "ordered"


def test_consecutive_duplicates(blocks):
    df = blocks([{"text": t} for t in ("a b", "a  b", "c", "a b")])
    assert column(M.drop_consecutive_duplicates(df), "text") == ["a b", "c", "a b"]
    assert df.filter(F.col("text") == "c").count() == 1
