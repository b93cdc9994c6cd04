from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quirework.functions import clean as C
from quirework.functions import patterns as P
from quirework.functions import text as T

CASES = [
    (T.sentence_complete, ["It ends.", "He said “yes.”", "वाक्य पूरा।", "trails...", ""], ["no end", "अधूरा वाक्य"]),
    (T.is_continuation, ["and then", "(aside)", "42 more"], ["Then", ""]),
    (T.is_section_label, ["Preface", "PART iv", "chapter 12", "Table of  Contents"], ["Preface to it", ""]),
    (T.is_citation_heavy, ["see https://x.y", "doi:10.1", "[1] and [2]", "Smith et al 1999", "1990, 1991 and 1992"],
     ["plain words", "in 1999"]),
    (T.skip_sentence, ["", "Hm.", "Figure 3: a thing", "--- 12345 ---"], ["Plain readable words here."]),
    (T.is_running_header,
     ["Contents Preface Introduction: a power | Thinking badly", "Contents Preface Introduction: Everyday power",
      "Chapter 3 | Habits Matter", "PART II | New Rules", "Contents Part 2 of it"],
     ["Contents of the previous chapter were unclear.", "a | b", "Contents"]),
    (T.is_toc_trigger, ["Contents", "TABLE OF CONTENTS page", "contents page"], ["Contents of it", ""]),
    (T.is_milestone_heading, ["Chapter One", "3. Title", "IV. Title", "Prologue"], ["A Title", "Prologues"]),
    (T.is_imprint, ["Printed in England", "All Rights Reserved", "Penguin Books"], ["A quiet line"]),
    (T.is_toc_leader_row, ["White nights ..... 4", "Preface … vii"], ["Plain 4", "dots .... here"]),
    (T.is_toc_heading_noise,
     ["Part 1. The Enemies of Thought 4", "CHAPTER 1.1 ............... 16", "CONCLUSION THE VALUE OF THOUGHT 8"],
     ["Part 1. The Enemies of Thought", "Chapter 1", "Part I", "Chapter 1: Opening in the body without page column"]),
    (T.is_merged_toc_blob,
     ["Cover Title Page Dedication Preface: Before Entry Author Note Chapter 1: Phone Booth",
      " ".join(f"Chapter {i}: T{i}" for i in range(2, 12)) + " Acknowledgments Notes",
      "What is this thing? Why does it matter so? How do we go on from here? Tell me."],
     ["Chapter 1: One", "A plain paragraph of text that is long enough to be looked at, but not a list."]),
    (T.starts_contents_region, ["Contents\nPART 1 ........ 14", "Contents"], ["Contents\nA real sentence follows", "Text"]),
    (T.is_back_matter_heading, ["Notes", "Works Cited", "Appendix B", "Glossary of terms", "Copyrights"],
     ["Notes on it", "An Index of sorts", "Acknowledgments"]),
    (T.is_copyright_block, ["© 2001 X", "ISBN 978-0-123456-7"], ["right of copy"]),
    (T.is_distributor_boilerplate, ["Found at manybooks.net today", "A free ebook from X"],
     ["Visit my website manybooks.net", "free ebook"]),
    (T.is_chapter_like, ["Chapter 3", "PART ONE", "12", "Law 4 Never", "Section 3 Title", "1.2 The Default", "Act IV"],
     ["Section 1.1", "Section 3 of the law", "A chapter", "1234"]),
    (T.is_caps_emphasis, ["MOMENT WHEN YOU NEED TO THINK!", "STOP RIGHT THERE!'"], ["INTRODUCTION", "Moment to think!"]),
    (T.is_typographic_heading, ["INTRODUCTION", "THE LAST LIGHT"],
     ["MOMENT WHEN YOU NEED TO THINK!", "AND SO, AS THEY WENT ON, IT WAS", "A Mixed Line", "ENDING,"]),
    (T.is_page_number, ["12", "- 12 -", "Page 7"], ["12 men", ""]),
    (T.is_toc_leader_or_leaf, ["Preface ... vii"], ["From early morning I had been oppressed by a"]),
    (T.is_likely_truncated, ['He said "stop and never came', "She “opened and never closed"], ['He said "stop" and left it there']),
    (T.opens_with_quote, ["“Yes", '"No', "« Oui"], ["Yes", ""]),
]


@pytest.mark.parametrize("rule,yes,no", CASES, ids=[c[0].__name__ for c in CASES])
def test_rule(spark, rule, yes, no):
    rows = [(t, True) for t in yes] + [(t, False) for t in no]
    df = spark.createDataFrame(rows, "text string, want boolean").withColumn("got", rule(F.col("text")))
    wrong = [(r["text"], r["got"]) for r in df.collect() if r["got"] != r["want"]]
    assert not wrong


def _one(spark, fn, text):
    return spark.createDataFrame([(text,)], "text string").select(fn(F.col("text")).alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [
    ("Notes Index Preface Maine started working in August.", "Maine started working in August."),
    ("Notes Index to the reader about lines.", "Notes Index to the reader about lines."),
    ("Index of figures appears here.", "Index of figures appears here."),
    ("Preface Maine story", "Preface Maine story"),
])
def test_nav_crumbs(spark, text, want):
    assert _one(spark, T.strip_nav_crumbs, text) == want


def test_outline_split_needs_three_items(spark):
    assert _one(spark, T.decimal_outline_split, "1.1 First title 1.2 Second title 1.3 Third title") == [
        "1.1 First title", "1.2 Second title", "1.3 Third title"]
    assert _one(spark, T.decimal_outline_split, "1.1 First title here 1.2 Second title here") is None


@pytest.mark.parametrize("text,want", [
    ("preface", "Preface"), ("CHAPTER 1: Open", "Chapter 1: Open"), ("acknowledgements to all", "Acknowledgments to all"),
    ("PART two", "Part two"), ("Parting words", "Parting words"),
])
def test_display_heading(spark, text, want):
    assert _one(spark, C.display_heading, text) == want


@pytest.mark.parametrize("text,want", [
    ("assistant to=json code to=json code to=json code\nReal line", "Real line"),
    ("WHITE NIGHTS WHITE NIGHTS 14\nBody", "Body"),
    ("before to=json code to=json code after", "before after"),
    ("one\n\n\n\ntwo", "one\n\ntwo"),
    ("Plain prose stays as it is.", "Plain prose stays as it is."),
])
def test_sanitize(spark, text, want):
    assert _one(spark, C.sanitize_output, text) == want


def test_markdown_and_reflow(spark):
    assert _one(spark, C.strip_markdown, "## A **bold _and_** [link](http://x) `code`") == "A bold and link code"
    assert _one(spark, C.reflow, "a line\nwrapped\n\nnext one\nhere") == "a line wrapped\n\nnext one here"


def test_prices_round_half_to_even(spark):
    df = spark.createDataFrame([(w,) for w in (0, 505051, 1010101, 100000, -5)], "w long")
    got = [r["p"] for r in df.select(C.payg_price(F.col("w")).alias("p")).collect()]
    assert got == [float(round((max(0, w) / 100_000) * 99.0)) for w in (0, 505051, 1010101, 100000, -5)]


def test_unicode_word_count_matches_python(spark):
    import re

    from conftest import SF_DIR

    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select(
        "text", T.word_count(F.col("text")).alias("n"), T.token_words(F.col("text")).alias("t")).collect()
    assert all(r["n"] == len(re.findall(r"\w+", r["text"])) for r in rows)
    assert all(r["t"] == len(r["text"].split()) for r in rows)


def test_squash_and_counts_equal_their_plain_forms(spark):
    """Squashing by uneven white space only, token counts from squashed texts and counts outside generated code."""
    texts = ["", " ", "a", " a  b ", "a\tb", "a \t b\n", "\t a", "a b c", "a b  c", "\x1ca \x85 b", "नमस्ते  दुनिया! Ünï_9", "..a-b..", "ABC déf GHI!", "  \n "]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    t = F.coalesce("t", F.lit(""))
    plain = F.trim(F.regexp_replace(t, f"{P.S}+", " "))
    rows, x = T.Line.prepare(df, "t")
    counted = {p: F.size(F.regexp_extract_all(t, F.lit(p), F.lit(0))) for p in (P.TOKEN, P.WORD, P.LETTER, P.UPPER)}
    ratio = F.when(counted[P.LETTER] > 0, counted[P.UPPER] / counted[P.LETTER]).otherwise(F.lit(0.0))
    for r in rows.select(
            (T.squash(F.col("t")) == plain).alias("sq"), (x.tokens == counted[P.TOKEN]).alias("tok"), (T.Line(F.col("t")).tokens == counted[P.TOKEN]).alias("raw"),
            (x.words == counted[P.WORD]).alias("words"), (T.upper_ratio(t) == ratio).alias("ratio"), (x.low_st == F.lower(x.st)).alias("low")).collect():
        assert all(r), r


def test_counts_stay_out_of_generated_methods(spark):
    """A match a letter or a word each is no loop inside a stage's generated method."""
    df = spark.range(1).select(F.col("id").cast("string").alias("text"))
    for c in (T.count_of(F.col("text"), P.WORD), T.upper_ratio(F.col("text"))):
        plan = df.select(c.alias("n"))._jdf.queryExecution().executedPlan().toString()
        assert "transform(array(" in plan
