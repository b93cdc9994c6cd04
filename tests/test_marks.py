from __future__ import annotations

import re

from conftest import SF_DIR
from pyspark.sql import functions as F

from quirework.functions import clean as C
from quirework.functions import text as T
from quirework.operators import marks as MK
from quirework.operators.ordered import numbered, pinned
from quirework.plans import derived, structure_queries


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_costly_arrays_are_made_once(spark):
    """Before an inner generator Spark filters on the size of its array, which makes all of it a second time."""
    texts = spark.createDataFrame([("a b",)], "t string")
    words = pinned(texts, {"w": F.upper("t")})
    lines = numbered(texts, ["t"], F.split("t", " "), "at", "w")
    for df in (words, lines, derived.book(spark, SF_DIR)):
        assert "size(" not in "".join(re.findall(r"Filter .*", _plan(df)))
    assert [tuple(r) for r in lines.collect()] == [("a b", 0, "a"), ("a b", 1, "b")]
    empty = numbered(texts, ["t"], F.expr("filter(split(t, ' '), w -> w = 'x')"), "at", "w")
    assert empty.count() == 0


def test_texts_are_looked_at_once(spark):
    """Shards join in one pass over the blocks, and classification reads marks, no texts."""
    assert _plan(structure_queries.merged_shards(spark, SF_DIR)).count("Relation [") == 1
    actions = _plan(structure_queries.book_actions(spark, SF_DIR))
    assert "Relation [" not in actions and "regexp" not in actions and "RLIKE" not in actions


def test_marks_are_those_of_the_rules(spark):
    """All marks of a text in one number, and each alone, are what the rules say of it."""
    texts = ["", " ", "Contents", "Chapter 1: One", "1.1 A 1.2 B 1.3 C", "Part 2 of it", "STOP! the worksheet", "He said. Then", "Printed in Rome", "Intro ..... 12",
             "Contents\nIntro ..... 12", "Chapter 1 a Chapter 2 b Chapter 3 c Chapter 4 d and a few more words so that it is long", None]
    df = spark.createDataFrame(list(enumerate(texts)), "pos int, text string")
    rows, x = T.Line.prepare(df)
    want = rows.select("pos", *[rule(x).alias(name) for name, rule in MK._RULES.items()]).orderBy("pos").collect()
    got = MK.marked(df).select("pos", *[MK.has(name).alias(name) for name in MK._RULES], "_opener", "_major", "_majors").orderBy("pos").collect()
    assert [r.asDict() for r in want] == [{k: v for k, v in r.asDict().items() if k in want[0].asDict()} for r in got]
    assert [(r["_opener"], r["_major"], r["_majors"]) for r in got][4:6] == [(None, 1, 3), (2, None, 0)]
    assert want[2]["trigger"] and want[10]["starts"] and want[11]["blob"] and want[6]["educational"] and not want[12]["filled"]


def test_clean_paragraph_without_marks_is_stripped_only(spark):
    texts = ["  plain words 　", "a *b* c", "# head", "one\r\ntwo", "x [y](z) `q`", None, "", "a_b __c__"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(C.clean_paragraph(F.col("t")), C.reflow(C.strip_markdown(F.col("t")))).collect()
    assert [r[0] for r in got] == [r[1] for r in got]
