"""Word-budget previews over ordered blocks.

Running word counts go through ``ordered.running``: only counts cross chunk
borders, so one very long document is still split over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.config import DEFAULTS
from quirework.functions import patterns as P
from quirework.functions import text as T
from quirework.operators.ordered import Sequence, running

BLOCKS = Sequence(("doc_id",), ("pos",), "pos div 4096")


def _with_words(blocks: DataFrame) -> DataFrame:
    cells = F.col("data") if "data" in blocks.columns else None
    return blocks.withColumn("_w", T.token_words(F.col("text"), cells).cast("long"))


def trim_words(text: Column, n: Column) -> Column:
    """First ``n`` tokens joined by spaces; shorter texts are only stripped."""
    tokens = F.regexp_extract_all(T.blankless(text), F.lit(P.TOKEN), F.lit(0))
    return F.when(F.size(tokens) <= n, T.strip(text)).otherwise(
        F.array_join(F.slice(tokens, F.lit(1), F.greatest(n, F.lit(0)).cast("int")), " ")
    )


def trim_cells(data: Column, n: Column) -> Column:
    """Table cells cut at the n-th word, row by row; later rows are dropped."""

    def cell_step(acc: Column, cell: Column) -> Column:
        words = T.token_words(cell)
        left = n - acc["used"]
        kept = (
            F.when(left <= 0, F.lit(""))
            .when(words <= left, T.blankless(cell))
            .otherwise(trim_words(cell, left))
        )
        return F.struct(
            (acc["used"] + F.least(words, F.greatest(left, F.lit(0)))).cast("int").alias("used"),
            F.concat(acc["cells"], F.array(kept)).alias("cells"),
        )

    def row_step(acc: Column, row: Column) -> Column:
        start = F.struct(acc["used"].alias("used"), F.array().cast("array<string>").alias("cells"))
        done = F.aggregate(row, start, cell_step)
        full = acc["used"] >= n
        return F.struct(
            F.when(full, acc["used"]).otherwise(done["used"]).alias("used"),
            F.when(full, acc["rows"]).otherwise(F.concat(acc["rows"], F.array(done["cells"]))).alias("rows"),
        )

    zero = F.struct(F.lit(0).alias("used"), F.array().cast("array<array<string>>").alias("rows"))
    return F.aggregate(data, zero, row_step, lambda acc: acc["rows"])


def limit_words(blocks: DataFrame, max_words: int = DEFAULTS.preview_max_words) -> DataFrame:
    """Leading blocks within the budget, the first one over it trimmed."""
    summed = running(_with_words(blocks), BLOCKS, {"_cum": ("sum", F.col("_w"))})
    left = (F.lit(max_words) - (F.col("_cum") - F.col("_w"))).cast("int")
    fits = F.col("_cum") <= max_words
    kept = summed.filter(fits | (left >= 1))
    out = kept.withColumn("text", F.when(fits, F.col("text")).otherwise(trim_words(F.col("text"), left)))
    shown = fits | (F.col("text") != "")
    if "data" in blocks.columns:
        table = F.col("type") == "table"
        out = out.withColumn(
            "data", F.when(fits | ~table, F.col("data")).otherwise(trim_cells(F.col("data"), left))
        )
        filled = F.exists(F.flatten("data"), T.has_text)
        shown = fits | (~table & (F.col("text") != "")) | (table & F.coalesce(filled, F.lit(False)))
    return out.filter(shown).drop("_w", "_cum")


def split_preview(blocks: DataFrame, max_pages: int = DEFAULTS.preview_max_pages,
                  words_per_page: int = DEFAULTS.preview_words_per_page,
                  by_page: bool = False) -> DataFrame:
    """Adds ``in_preview``: by page number, or by pages worth of words.

    The first block is always in; a later one while the budget is not yet spent and
    it still fits. Both conditions only get falser along the order.
    """
    if by_page:
        return blocks.withColumn("in_preview", F.coalesce(F.col("source_page") <= max_pages, F.lit(False)))
    budget = max(1, max_pages * max(50, words_per_page))
    summed = running(
        _with_words(blocks), BLOCKS, {"_cum": ("sum", F.col("_w")), "_nth": ("sum", F.lit(1).cast("long"))}
    )
    inside = (F.col("_nth") == 1) | (
        (F.col("_cum") <= budget) & (F.col("_cum") - F.col("_w") < budget)
    )
    return summed.withColumn("in_preview", inside).drop("_w", "_cum", "_nth")


def eligibility(docs: DataFrame, words: str = "words", max_pages: int = DEFAULTS.preview_max_pages,
                words_per_page: int = DEFAULTS.preview_words_per_page) -> DataFrame:
    """Estimated pages and whether a preview is offered."""
    wpp = max(50, words_per_page)
    pages = F.greatest(F.lit(1), F.ceil(F.greatest(F.col(words), F.lit(0)) / wpp)).cast("int")
    cap = max(1, max_pages)
    return docs.withColumns({"pages": pages, "preview_cap": F.lit(cap), "preview_eligible": pages > cap})
