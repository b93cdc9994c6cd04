"""Block tables with book-like structure, derived from the document lines.

The source texts hold prose only, so every line is re-labelled by position: some
become chapter headings, contents rows, imprints, page furniture and so on. The template of
its style shows the line's first words; those that it does not show follow as a paragraph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.operators.ordered import pinned
from quirework.plans.duck import LINES, q, squash
from quirework.sources import corpus, tables

# style -> (block type, level, template); {1} {2} {3} {5} are that many leading words,
# {U} the first three in capitals, {p} the position, {n} a part number, {t} the text
_STYLES: tuple[tuple[str, int, str], ...] = (
    ("heading", 1, "Chapter {p}: {3}"),
    ("heading", 2, "{3}"),
    ("heading", 2, "{U}"),
    ("paragraph", 1, "{3} ........ {p}"),
    ("heading", 1, "Contents"),
    ("heading", 2, "Notes"),
    ("paragraph", 1, "Printed in {2}"),
    ("heading", 3, "Index"),
    ("paragraph", 1, "page {p}"),
    ("list", 1, "1. {2}\n2. {3}"),
    ("heading", 1, "Part {n}. {2}"),
    ("paragraph", 1, "{n}.1 {1} {n}.2 {1} {n}.3 {2}"),
    ("heading", 3, "{2}"),
    ("paragraph", 1, "“{t}"),
    ("paragraph", 1, "Contents Preface {5}"),
    ("paragraph", 1, "© 2001 {2}"),
    ("paragraph", 1, "Chapter 1: {2} Chapter 2: {2} Chapter 3: {2} Chapter 4: {2} Chapter 5: {2} Notes"),
    ("paragraph", 1, "{5}"),
    ("heading", 2, "Summary"),
    ("heading", 2, "{5}, {5}"),
    ("heading", 2, "{U}!"),
    ("paragraph", 1, "Notes Index Preface {t}"),
    ("paragraph", 1, "{t}"),
    ("paragraph", 1, "{t}"),
    ("heading", 2, "Introduction"),
    ("paragraph", 1, "{U} .......... {p}"),
    ("paragraph", 1, "{3} .......... {p}"),
    ("paragraph", 1, "{t}"),
    ("paragraph", 1, "{5} -"),
    ("paragraph", 1, "{3}"),  # opening line
    ("paragraph", 1, "by {2}"),  # second line
)
_CYCLE = len(_STYLES) - 2


def _shown(template: str) -> int:
    """How many of a line's words a template shows; the whole text counts as more than any line has."""
    return max([n for mark, n in (("{1}", 1), ("{2}", 2), ("{3}", 3), ("{5}", 5), ("{U}", 3), ("{t}", 1 << 30)) if mark in template], default=0)


def balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in as many partitions as shuffles have.

    The rules cost far more than moving the texts once, and a file of one row group, or a split with long documents, would be one task's work.
    """
    tasks = spark.conf.get("quirework.scan.tasks", spark.conf.get("spark.sql.shuffle.partitions"))
    return tables.table(spark, sf_dir, "documents").select("doc_id", "text").repartition(int(tasks))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.line_blocks(balanced(spark, sf_dir)).select("doc_id", "pos", "text")


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks numbered inside the row that holds the document.

    A line is squashed once, and the templates are filled once: pinned, so that no later filter repeats them. The lines are generated
    by an outer generator: before an inner one Spark adds a filter on the size of its array, which makes all of the array a second time.
    """
    docs = balanced(spark, sf_dir)

    def style_of(doc: Column, line: Column) -> Column:
        return F.when(line < 2, line + _CYCLE).otherwise((doc * 31 + line) % _CYCLE).cast("int")

    def pick(style: Column, values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), style + 1)

    def parts(both: Column, line: Column) -> Column:
        """A line's styled block and, where that does not show all words, the rest."""
        text, sq = both["text"], both["sq"]
        more = T.squashed_tokens(sq) > pick(style_of(F.col("doc_id"), line), [_shown(s[2]) for s in _STYLES])
        each = lambda n: F.struct(line.alias("line"), F.lit(n).alias("part"), text.alias("text"), sq.alias("sq"))
        return F.when(text == "", F.slice(F.array(each(0)), 1, 0)).when(more, F.array(each(0), each(1))).otherwise(F.array(each(0)))

    pairs = F.transform(corpus.text_lines(F.col("text")), lambda t: F.struct(t.alias("text"), T.squash(t).alias("sq")))
    rows = docs.select("doc_id", F.posexplode_outer(F.flatten(F.transform(pairs, parts))).alias("pos", "_p")).filter("_p IS NOT NULL")
    src = rows.select("doc_id", "pos", "_p.*").withColumn("_style", style_of(F.col("doc_id"), F.col("line")))

    def block(r: Column) -> Column:
        """One template filled mark by mark, or the words that it does not show."""
        style, sq, rest = r["_style"], r["sq"], r["part"] == 1

        def first(n: int) -> Column:
            return F.substring_index(sq, " ", n)

        marks = {
            "{1}": first(1), "{2}": first(2), "{3}": first(3), "{5}": first(5),
            "{U}": F.upper(F.regexp_replace(first(3), "[^A-Za-z ]", "")),
            "{p}": r["line"].cast("string"),
            "{n}": (r["doc_id"] % 3 + 1).cast("string"),
            "{t}": r["text"],
        }

        def used(mark: str) -> Column:
            """What stands for a mark, worked out only for the styles that have it."""
            return F.when(pick(style, [mark in s[2] for s in _STYLES]), marks[mark]).otherwise("")

        styled = reduce(lambda t, m: F.replace(t, F.lit(m), used(m)), marks, pick(style, [s[2] for s in _STYLES]))
        shown = pick(style, [_shown(s[2]) for s in _STYLES])
        head = reduce(lambda t, n: F.when(shown == n, F.length(first(n))).otherwise(t), sorted({_shown(s[2]) for s in _STYLES} - {0, 1 << 30}), F.length(sq))
        # A line that shows no word has no space to leave out either.
        tail = F.when(shown == 0, sq).otherwise(F.substring(sq, head + 2, F.length(sq)))
        return F.struct(
            F.when(rest, "paragraph").otherwise(pick(style, [s[0] for s in _STYLES])).alias("type"),
            F.when(rest, tail).otherwise(styled).alias("text"),
            F.when(rest, 1).otherwise(pick(style, [s[1] for s in _STYLES])).alias("level"),
            F.when((style == 9) & ~rest, "ordered").alias("list_kind"),
        )

    # Outside generated code: loops over words in a method too long for the JIT compiler are interpreted.
    made = pinned(src, {"_made": T.apart(F.struct("doc_id", "line", "part", "text", "sq", "_style"), block), "source_page": F.expr("cast(line div 4 as int) + 1")})
    return made.select("doc_id", "pos", "_made.*", "source_page")


def _first(n: int) -> str:
    return f"array_to_string(w[1:{n}], ' ')"


_MARKS = {
    "{1}": _first(1), "{2}": _first(2), "{3}": _first(3), "{5}": _first(5),
    "{U}": f"upper(regexp_replace({_first(3)}, '[^A-Za-z ]', '', 'g'))",
    "{p}": "pos::VARCHAR", "{n}": "(doc_id % 3 + 1)::VARCHAR", "{t}": "text",
}
_FILLED = reduce(lambda t, m: f"replace({t}, {q(m[0])}, {m[1]})", _MARKS.items(), "template")
_ROWS = ", ".join(f"({i}, {q(t)}, {lvl}, {q(tpl)}, {_shown(tpl)})" for i, (t, lvl, tpl) in enumerate(_STYLES))

BOOK = f"""{LINES},
styles(style, type, level, template, shown) AS (VALUES {_ROWS}),
styled AS (
  SELECT doc_id, pos, text, string_split({squash('text')}, ' ') AS w,
         CASE WHEN pos < 2 THEN pos + {_CYCLE} ELSE (doc_id * 31 + pos) % {_CYCLE} END AS style
  FROM lines
),
parts AS (
  SELECT doc_id, pos AS line, 0 AS part, type, {_FILLED} AS text, level, CASE WHEN style = 9 THEN 'ordered' END AS list_kind
  FROM styled JOIN styles USING (style)
  UNION ALL
  SELECT doc_id, pos, 1, 'paragraph', array_to_string(w[shown + 1:], ' '), 1, NULL FROM styled JOIN styles USING (style) WHERE shown < len(w)
),
book AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, part) - 1 AS pos, type, text, level, list_kind,
    (line // 4 + 1)::INTEGER AS source_page
  FROM parts
)"""
