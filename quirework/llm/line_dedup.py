"""Line de-duplication by overlapping windows of lines (operator 10, DataFrame functions only).

Consecutive lines are hashed, windows that occur again anywhere are found by one aggregate, and the
later occurrences' positions are merged and cut out of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.shared import whole
from quirework.operators.ordered import pinned

#: White space at the ends of a line that does not tell lines apart.
_EDGE = "\x20\x09\x0b\x0c\x0d"


def _line_hashes(lines: Column) -> Column:
    """(i, h) of each line that is not blank: its index and a hash of it without edge space."""
    each = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(_EDGE)).alias("t")))
    return F.transform(F.filter(each, lambda s: s["t"] != ""), lambda s: F.struct(s["i"].alias("i"), F.xxhash64(s["t"]).alias("h")))


def remove_repeated_windows(docs: DataFrame, *, width: int = 3) -> DataFrame:
    """``docs`` with text less its repeated passages, and n_lines, n_removed, removed.

    A window is ``width`` consecutive lines that are not blank, without white space at their ends;
    two are the same when all their line hashes are. The first occurrence, by doc_id and then by
    place, stays; every line that a later occurrence covers goes, with the blank lines between. Where
    a later occurrence overlaps the first one in the same text, the first one's lines stay. Texts of
    fewer lines have no window and stay as they are. n_lines counts all lines, removed lists
    the removed line numbers from 0.

    A null text stays null with 0 lines; an empty one has one line. A null doc_id comes first. Rows
    equal in doc_id and text are one document: all of them get the same result. Other columns
    pass through unless they bear one of the three names, which are then replaced. An empty
    table gives an empty one.

    Only windows that repeat are gathered again; a very common window is a skewed join, which
    adaptive execution splits, and is otherwise counted by partial aggregates.
    """
    made = ("n_lines", "n_removed", "removed")
    docs = docs.drop(*[c for c in docs.columns if c in made])
    lines = F.split(whole(F.col("text")), "\n", -1)
    ident = F.xxhash64("text")
    hashed = pinned(docs.select("doc_id", "text"), {"_text": ident, "_l": _line_hashes(lines)}).filter(F.size("_l") >= width)
    # Rows equal in doc_id and text have the same windows: one of them forms these.
    hashed = hashed.groupBy("doc_id", "_text").agg(F.first("_l").alias("_l"))
    starts = F.sequence(F.lit(1), F.size("_l") - (width - 1))
    window = F.transform(starts, lambda j: F.struct(
        (j - 1).cast("int").alias("at"),
        F.element_at("_l", j)["i"].alias("lo"), F.element_at("_l", j + (width - 1))["i"].alias("hi"),
        *[F.element_at("_l", j + k)["h"].alias(f"h{k}") for k in range(width)],
    ))
    windows = hashed.select("doc_id", "_text", F.inline(window))
    keys = [f"h{k}" for k in range(width)]
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "_text", "at")
    repeated = windows.groupBy(*keys).agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(F.col("first") < F.col("last")).select(
        *keys, F.col("first.doc_id").alias("_doc"), F.col("first._text").alias("_own"), F.col("first.at").alias("_at"))

    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_own"))
    later = windows.hint("merge").join(repeated, keys).filter(~(same & (F.col("at") == F.col("_at"))))
    later = later.select("doc_id", "_text", F.struct("at", "lo", "hi", F.when(same, F.col("_at")).alias("own")).alias("w"))
    cuts = later.groupBy("doc_id", "_text").agg(F.collect_list("w").alias("_cuts"))

    rows = docs.select(F.struct("*").alias("in"), "doc_id", "text", ident.alias("_text"))
    joined = rows.alias("d").join(
        cuts.hint("shuffle_hash").alias("c"),
        F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("d._text") == F.col("c._text")), "left",
    ).select("d.in", F.col("d.text").alias("text"), "c._cuts")
    hit = F.col("_cuts").isNotNull()
    cut = pinned(joined, {"_lines": lines, "_at": F.when(hit, _line_hashes(lines))})
    # A window that overlaps its own first occurrence starts behind that one.
    low = lambda w: F.when(
        w["own"] + width > w["at"], F.element_at("_at", w["own"] + (width + 1))["i"]).otherwise(w["lo"])
    gone = F.array_distinct(F.flatten(F.transform("_cuts", lambda w: F.sequence(low(w), w["hi"]))))
    cut = pinned(cut, {"_gone": F.when(hit, F.array_sort(gone)).otherwise(F.array().cast("array<int>"))})
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    return cut.select(
        *[F.col(f"in.`{c}`") for c in docs.columns if c != "text"],
        F.when(hit, F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.size("_gone").cast("long").alias("n_removed"),
        F.col("_gone").alias("removed"),
    )
