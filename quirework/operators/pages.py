"""Page-line operators: lines to runs, runs to typed blocks, repeated page furniture.

``LINES`` rows are already decoded text lines with spans and a box. Windows here
are keyed by (document, page): a printed page bounds what one task sees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import patterns as P
from quirework.functions import text as T

_TEXTUAL = ("heading", "paragraph", "list")
_RUN_GAP = 14.0
_DEFAULT_BODY_FONT = 11.0
_DELTA_SUB, _DELTA_MAJOR = 3.25, 7.0
# font-name fragments that mean bold (fixed values)
_BOLD_NAMES = ("bold", "-bd", "black", "heavy", "semibold", "demibold")


def body_font(lines: DataFrame) -> DataFrame:
    """Upper median of span sizes per document.

    Sizes are counted first, so only the few distinct sizes of a document meet in
    one place however many spans it has.
    """
    sizes = lines.select("doc_id", F.explode("spans.size").alias("size")).filter(F.col("size") > 0)
    counted = sizes.groupBy("doc_id", "size").agg(F.count(F.lit(1)).alias("n"))
    by_size = Window.partitionBy("doc_id").orderBy("size")
    placed = counted.withColumns({
        "upto": F.sum("n").over(by_size),
        "half": F.expr("sum(n) over (partition by doc_id) div 2"),
    })
    return placed.filter(F.col("upto") > F.col("half")).groupBy("doc_id").agg(
        F.min("size").alias("body_font")
    )


def _span_bold(sp: Column) -> Column:
    font = F.lower(T.blankless(sp["font"]))
    named = font.contains(_BOLD_NAMES[0])
    for n in _BOLD_NAMES[1:]:
        named = named | font.contains(n)
    return named | (F.coalesce(sp["flags"], F.lit(0)).bitwiseAND(16) > 0)


def bold_share(spans: Column) -> Column:
    """Share of visible-span characters set in bold."""
    shown = F.filter(spans, lambda s: T.has_text(s["text"]))

    def chars(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda a, s: a + F.length(s["text"]))

    total = chars(shown)
    return F.when(total > 0, chars(F.filter(shown, _span_bold)) / total).otherwise(F.lit(0.0))


def line_measures(lines: DataFrame) -> DataFrame:
    """Text, largest font and bold share per line; lines without text are dropped."""
    shown = F.filter(
        F.transform("spans", lambda s: F.struct(T.strip(s["text"]).alias("t"), s["size"].alias("z"))),
        lambda s: s["t"] != "",
    )
    return (
        lines.withColumns({"_shown": shown, "bold": bold_share(F.col("spans"))})
        .filter(F.size("_shown") > 0)
        .withColumns({
            "text": T.strip(F.array_join("_shown.t", " ")),
            "max_size": F.greatest(F.array_max("_shown.z"), F.lit(0.0)),
        })
        .drop("_shown", "spans")
    )


#: Beyond this, coordinates share the outermost cells of a grid.
_EDGE = 1e15


def outside_tables(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Drop lines whose centre lies in a table box of their page; a line is known by doc_id, page and line_no.

    A box lies in the at most four cells that it touches of the grid whose cells are as wide as its longer side (a power
    of two); a line asks one cell of each width that its page's boxes use. So a page with many lines and many boxes is no product of both.
    """
    key, cell = ["doc_id", "page"], ["doc_id", "page", "_level", "_x", "_y"]
    tame = lambda c: F.greatest(F.lit(-_EDGE), F.least(F.lit(_EDGE), c))
    place = lambda c, level: F.floor(tame(c) / F.pow(F.lit(2.0), level)).cast("long")
    b = boxes.filter("x0 <= x1 AND y0 <= y1").select(
        *key, *[F.col(c).cast("double").alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    side = F.greatest(tame(F.col("bx1")) - tame(F.col("bx0")), tame(F.col("by1")) - tame(F.col("by0")), F.lit(1.0))
    b = b.withColumn("_level", F.ceil(F.log2(side)).cast("int"))
    b = b.withColumn("_x", F.explode(F.sequence(place(F.col("bx0"), F.col("_level")), place(F.col("bx1"), F.col("_level")))))
    b = b.withColumn("_y", F.explode(F.sequence(place(F.col("by0"), F.col("_level")), place(F.col("by1"), F.col("_level")))))
    widths = b.groupBy(*key).agg(F.collect_set("_level").alias("_levels"))
    cx, cy = ((F.col(f"{c}0") + F.col(f"{c}1")) / 2 for c in "xy")
    centres = lines.select(*key, "line_no", cx.alias("_cx"), cy.alias("_cy")).filter("_cx IS NOT NULL AND _cy IS NOT NULL")
    asked = centres.join(widths, key).withColumn("_level", F.explode("_levels")).withColumns(
        {"_x": place(F.col("_cx"), F.col("_level")), "_y": place(F.col("_cy"), F.col("_level"))})
    met = asked.join(b.select(*cell, "bx0", "by0", "bx1", "by1"), cell)
    hit = met.filter("_cx BETWEEN bx0 AND bx1 AND _cy BETWEEN by0 AND by1").select(*key, "line_no").distinct()
    return lines.join(hit, [*key, "line_no"], "left_anti").select(*lines.columns)


def line_runs(measured: DataFrame) -> DataFrame:
    """Q1: consecutive lines of a page whose tops are at most 14 points apart."""
    page = ["doc_id", "page"]
    by_line = Window.partitionBy(*page).orderBy("line_no")
    jump = F.abs(F.col("y0") - F.lag("y0").over(by_line)) > _RUN_GAP
    marked = measured.withColumn("_jump", F.coalesce(jump, F.lit(False)).cast("int"))
    numbered = marked.withColumn("run", F.sum("_jump").over(by_line))
    runs = numbered.groupBy(*page, "run").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]
            ),
            " ",
        ).alias("text"),
        F.max("max_size").alias("max_size"),
        F.greatest(F.max("bold"), F.avg("bold")).alias("bold"),
        F.min("y0").alias("y0"),
        F.max("y1").alias("y1"),
        F.count(F.lit(1)).cast("int").alias("lines_merged"),
    )
    by_run = Window.partitionBy(*page).orderBy("run")
    return runs.withColumn("gap_before", F.col("y0") - F.lag("y1").over(by_run))


def type_runs(runs: DataFrame, fonts: DataFrame) -> DataFrame:
    """Q3: typed block per run, from font deltas, capitals, bold share and list marks."""
    joined = runs.join(fonts, "doc_id", "left").withColumn(
        "body_font", F.coalesce("body_font", F.lit(_DEFAULT_BODY_FONT))
    )
    rows, x = T.Line.prepare(joined)
    size, bold, wc = F.col("max_size"), F.col("bold"), F.col("_tokens")
    bigger = size >= F.col("body_font") + _DELTA_SUB
    emphasis = T.is_caps_emphasis(x)
    strong = (
        ~T.is_list_line(x) & (F.col("lines_merged") <= 2) & (wc <= 11) & (F.length("text") <= 160)
        & ~bigger & (bold >= 0.88)
        & ~(x.st.rlike(r"[.!?]$") & (wc > 9)) & ~(x.st.contains(",") & (wc >= 8))
    )
    kind = (
        F.when(T.is_toc_spill(x), "paragraph")
        .when(~emphasis & bigger & (wc <= 22),
              F.when(size >= F.col("body_font") + _DELTA_MAJOR, "heading1").otherwise("heading2"))
        .when(~emphasis & ~bigger & T.is_typographic_heading(x), "heading2")
        .when(~emphasis & strong, F.when(wc <= 6, "heading2").otherwise("heading3"))
        .when(T.is_list_line(x), F.when(T.is_ordered_line(x), "list_ordered").otherwise("list_bullet"))
        .otherwise("paragraph")
    )
    typed = rows.withColumn("_kind", kind)
    is_heading, is_list = F.col("_kind").startswith("heading"), F.col("_kind").startswith("list")
    return typed.select(
        "doc_id", "page", "run",
        F.when(is_heading, "heading").when(is_list, "list").otherwise("paragraph").alias("type"),
        "text",
        F.when(is_heading, F.substring("_kind", 8, 1).cast("int")).otherwise(1).alias("level"),
        F.when(is_list, F.substring("_kind", 6, 10)).alias("list_kind"),
        F.col("page").alias("source_page"),
        F.struct(
            F.col("max_size").alias("font_pt_max"), F.col("bold").alias("bold_fraction"),
            "lines_merged", "y0", "y1", F.col("gap_before").alias("gap_before_pt"),
            F.col("body_font").alias("body_font_pt"),
        ).alias("pdf_hints"),
    )


def page_blocks(lines: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """S4 + Q1 + Q3: decoded page lines to ordered typed blocks."""
    measured = line_measures(lines)
    if boxes is not None:
        measured = outside_tables(measured, boxes)
    blocks = type_runs(line_runs(measured), body_font(lines))
    order = Window.partitionBy("doc_id").orderBy("page", "run")
    return blocks.withColumn("pos", F.row_number().over(order) - 1).drop("page", "run")


def repeated_fragments(blocks: DataFrame, min_pages: int = 6, share: float = 0.20,
                       min_run: int = 5) -> DataFrame:
    """(doc_id, key) of short lines recurring on many or on consecutive pages.

    Occurrences collapse to distinct (document, key, page) before anything is
    ordered, so a line copied onto every page costs one row per page.
    """
    text = F.col("text")
    n_pages = blocks.groupBy("doc_id").agg(F.max("source_page").alias("n_pages"))
    tokens = T.token_words(text)
    on_page = (
        blocks.filter(
            F.col("type").isin(*_TEXTUAL) & F.col("source_page").isNotNull()
            & tokens.between(1, 14) & (F.length(T.strip(text)) <= 120) & ~T.is_page_number(text)
        )
        .select("doc_id", fragment_key(text).alias("key"), "source_page")
        .distinct()
    )
    by_page = Window.partitionBy("doc_id", "key").orderBy("source_page")
    islands = (
        on_page.withColumn("_island", F.col("source_page") - F.row_number().over(by_page))
        .groupBy("doc_id", "key", "_island").agg(F.count(F.lit(1)).alias("len"))
        .groupBy("doc_id", "key").agg(F.sum("len").alias("pages"), F.max("len").alias("longest"))
    )
    needed = F.greatest(F.lit(min_pages), F.floor(F.col("n_pages") * F.lit(share)).cast("int"))
    return (
        islands.join(n_pages, "doc_id")
        .filter((F.col("n_pages") >= 3)
                & ((F.col("pages") >= needed) | (F.col("longest") >= min_run)))
        .select("doc_id", "key", "pages", "longest")
    )


def fragment_key(text: Column) -> Column:
    return F.lower(T.squash(text))


def drop_repeated_fragments(blocks: DataFrame) -> DataFrame:
    """Blocks without repeated fragments and page numbers (documents of 3+ pages)."""
    hits = repeated_fragments(blocks).select(
        F.col("doc_id").alias("_d"), F.col("key").alias("_k")
    )
    n_pages = blocks.groupBy(F.col("doc_id").alias("_pd")).agg(F.max("source_page").alias("_n"))
    kept = blocks.join(
        hits,
        (F.col("doc_id") == F.col("_d")) & (fragment_key(F.col("text")) == F.col("_k"))
        & F.col("type").isin(*_TEXTUAL) & F.col("source_page").isNotNull(),
        "left_anti",
    )
    long_enough = kept.join(n_pages, F.col("doc_id") == F.col("_pd"), "left")
    numbers = (F.col("_n") >= 3) & T.is_page_number(F.col("text"))
    return long_enough.filter(~F.coalesce(numbers, F.lit(False))).drop("_pd", "_n")


def drop_page_furniture(blocks: DataFrame) -> DataFrame:
    """Q6: remove running headers, then navigation labels glued to paragraphs."""
    text = F.col("text")
    kept = blocks.filter(~(F.col("type").isin(*_TEXTUAL) & T.is_running_header(text)))
    bare = T.strip_nav_crumbs(text)
    return kept.withColumn(
        "text", F.when((F.col("type") == "paragraph") & (bare != ""), bare).otherwise(text)
    )


