"""Joining neighbouring blocks into one.

A merge gathers the pieces of one output text, so what meets in a task is bounded
by a text cell of the result, never by the document. Where a rule reads the text
merged so far, the pieces of one run are folded in order; everything else is a
window flag.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.operators import marks as MK


def by_doc() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("pos")



def merge_adjacent(blocks: DataFrame, k: int = 3, joiner: str = "\n\n",
                   same_page: bool = False) -> DataFrame:
    """Q2: up to ``k`` neighbouring paragraphs become one."""
    mergeable = (F.col("type") == "paragraph") & (F.coalesce(F.col("text"), F.lit("")) != "")
    joins = mergeable & F.lag(mergeable).over(by_doc())
    if same_page:
        joins = joins & F.col("source_page").eqNullSafe(F.lag("source_page").over(by_doc()))
    start = (~F.coalesce(joins, F.lit(False))).cast("int")
    islands = blocks.withColumn("_start", start).withColumn("_island", F.sum("_start").over(by_doc()))
    nth = F.row_number().over(Window.partitionBy("doc_id", "_island").orderBy("pos")) - 1
    bucketed = islands.withColumn("_bucket", F.floor(nth / k))
    rest = [c for c in blocks.columns if c not in ("doc_id", "text")]
    return (
        bucketed.groupBy("doc_id", "_island", "_bucket")
        .agg(
            F.min_by(F.struct(*rest), "pos").alias("_first"),
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]),
                joiner,
            ).alias("_joined"),
            F.count(F.lit(1)).alias("_n"),
            F.first("text").alias("_only"),
        )
        .select("doc_id", "_first.*",
                F.when(F.col("_n") > 1, F.col("_joined")).otherwise(F.col("_only")).alias("text"))
        .select(*blocks.columns)
    )


def fold_runs(
    blocks: DataFrame,
    joins_previous: Column,
    may_join: Callable[[Column, Column], Column],
    glue: Callable[[Column, Column], Column],
    last_wins: tuple[str, ...] = (),
) -> DataFrame:
    """Fold runs of linked rows; ``may_join`` / ``glue`` see (text so far, next text).

    ``joins_previous`` must be necessary for a merge, so rows of different runs can
    never merge. Columns in ``last_wins`` come from the last piece, others from the first.
    """
    marked = blocks.withColumn("_start", (~F.coalesce(joins_previous, F.lit(False))).cast("int"))
    runs = marked.withColumn("_run", F.sum("_start").over(by_doc())).drop("_start")
    piece = F.struct("pos", *[c for c in blocks.columns if c not in ("pos", "doc_id")])
    pieces = runs.groupBy("doc_id", "_run").agg(F.array_sort(F.collect_list(piece)).alias("_p"))
    fields = [f.name for f in pieces.schema["_p"].dataType.elementType.fields]

    def step(acc: Column, nxt: Column) -> Column:
        cur = acc["cur"]
        join = may_join(cur["text"], nxt["text"])
        merged = F.struct(*[
            (F.when(join, glue(cur["text"], nxt["text"])).otherwise(nxt["text"]) if f == "text"
             else F.when(join & F.lit(f not in last_wins), cur[f]).otherwise(nxt[f])).alias(f)
            for f in fields
        ])
        return F.struct(
            F.when(join, acc["done"]).otherwise(F.concat(acc["done"], F.array(cur))).alias("done"),
            merged.alias("cur"),
        )

    zero = F.struct(F.slice("_p", 1, 0).alias("done"), F.element_at("_p", 1).alias("cur"))
    folded = F.aggregate(F.slice("_p", F.lit(2), F.size("_p")), zero, step)
    single = F.size("_p") == 1
    out = F.when(single, F.col("_p")).otherwise(F.concat(folded["done"], F.array(folded["cur"])))
    return pieces.select("doc_id", F.inline(out)).select(*blocks.columns)


def stitch_pages(blocks: DataFrame) -> DataFrame:
    """Q5: rejoin paragraphs split by a page break, dropping a trailing hyphen."""
    text = F.col("text")
    body = (F.col("type") == "paragraph") & T.has_text(text)
    ready = blocks.withColumns({
        "_body": body,
        "_open": body & ~T.sentence_complete(text),
        "_row": T.is_toc_leader_or_leaf(text),
    })
    linked = (
        F.col("_body") & F.lag("_open").over(by_doc()) & ~F.col("_row")
        & (F.col("source_page") == F.lag("source_page").over(by_doc()) + 1)
    )

    def glue(cur: Column, nxt: Column) -> Column:
        left, right = T.rstrip(cur), T.lstrip(nxt)
        hyphen = left.endswith("-")
        bare = T.rstrip(F.substring(left, F.lit(1), F.length(left) - 1))
        return T.squash(F.when(hyphen, F.concat(bare, right)).otherwise(F.concat_ws(" ", left, right)))

    def may_join(cur: Column, nxt: Column) -> Column:
        return ~T.sentence_complete(cur) & ~T.is_toc_leader_or_leaf(cur)

    return fold_runs(ready, linked, may_join, glue, last_wins=("source_page",)).drop(
        "_body", "_open", "_row"
    )


def fold_caps_emphasis(blocks: DataFrame) -> DataFrame:
    """Q4: shouted lines typed as headings go back into the paragraph before them.

    A run is a row and the shouted headings right after it. Once one heading stays
    (its page differs), the row before the next is a heading, so none after it joins.
    """
    text = F.col("text")
    shout = (F.col("type") == "heading") & T.is_caps_emphasis(text)
    prior = T.rstrip(text)
    opens = (F.col("type") == "paragraph") & (F.length(prior) >= 12) & ~prior.endswith(".")
    ready = blocks.withColumns({"_shout": shout, "_opens": opens})
    grouped = ready.withColumn("_group", F.sum((~F.col("_shout")).cast("int")).over(by_doc()))
    in_group = Window.partitionBy("doc_id", "_group").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, 0
    )
    page = F.first("source_page").over(in_group)
    same = F.coalesce(F.col("source_page") == page, F.lit(True))
    flagged = grouped.withColumns({
        "_head_opens": F.first("_opens").over(in_group),
        "_same_page": F.min(same).over(in_group),
    })
    joins = F.col("_shout") & F.col("_head_opens") & F.col("_same_page")
    return _islands(flagged.withColumn("_start", ~F.coalesce(joins, F.lit(False))), blocks.columns, T.strip)


def merge_shards(classified: DataFrame) -> DataFrame:
    """Q16: translate paragraphs that are shards of one logical paragraph.

    Whether the text so far is complete, its last shard tells; a label in two or three shards (a word or more each) is
    the one thing that only the joined text shows. So flags of neighbours settle nearly all runs of linked shards; where
    two or three shards in a row spell a label, the run's flags, not its texts, are walked in order. A run is gathered once and cut where it stands.
    """
    columns, text, has = MK.unmarked(classified).columns, F.col("text"), MK.has
    marked = MK.marked(classified, *MK.SHARDS)
    body = (
        (F.col("action") == "TRANSLATE") & (F.col("type") == "paragraph") & has("visible")
        & ~F.coalesce(F.col("structural_tag").isin("title", "author", "toc"), F.lit(False))
    )
    ready = marked.withColumns({
        "text": F.when(body, T.strip(text)).otherwise(text),
        "_body": body,
        "_label": has("section_label"),
        "_closed": has("complete"),
        "_cont": has("continuation"),
        "_short": F.when(has("plain"), T.squash(text)),
    })

    def before(c: str, n: int = 1) -> Column:
        return F.lag(c, n).over(by_doc())

    linked = F.coalesce(
        F.col("_body") & before("_body") & ~F.col("_label") & ~before("_label")
        & (~before("_closed") | F.col("_cont")), F.lit(False))
    ready = ready.withColumns({"_linked": linked, "_one": before("_short"), "_two": before("_short", 2)})
    ready = ready.withColumn("_linked_2", F.col("_linked") & F.coalesce(before("_linked"), F.lit(False)))

    def label(linked: str, *parts: str) -> Column:
        known = F.col(linked)
        for part in parts:
            known = known & F.col(part).isNotNull()
        return F.when(known, T.apart(F.concat_ws(" ", *parts), lambda t: T.is_section_label(t))).otherwise(F.lit(False))

    ready = ready.withColumns({
        "_pair": label("_linked", "_one", "_short"),
        "_triple": label("_linked_2", "_two", "_one", "_short"),
    }).withColumn("_run", F.sum((~F.col("_linked")).cast("int")).over(by_doc()))
    rest = [c for c in columns if c not in ("doc_id", "pos", "text")]
    runs = ready.groupBy("doc_id", "_run").agg(
        F.array_sort(F.collect_list(F.struct("pos", "text", *rest, "_pair", "_triple"))).alias("_r"),
        F.min_by(F.struct("pos", "text", *rest), "pos").alias("_head"))
    zero = F.struct(F.array(F.lit(1)).alias("starts"), F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(False).alias("label"))

    def step(acc: Column, r: Column) -> Column:
        i, n = acc["i"] + 1, F.when(acc["label"], 1).otherwise(acc["n"] + 1)
        starts = F.when(acc["label"], F.concat(acc["starts"], F.array(i))).otherwise(acc["starts"])
        return F.struct(starts.alias("starts"), i.alias("i"), n.alias("n"), (((n == 2) & r["_pair"]) | ((n == 3) & r["_triple"])).alias("label"))

    walked = F.aggregate(F.transform("_r", lambda r: F.struct(r["_pair"].alias("_pair"), r["_triple"].alias("_triple"))), zero, step, lambda a: a["starts"])
    odd = F.exists("_r", lambda r: r["_pair"] | r["_triple"])

    def cell(rows: Column, head: Column) -> Column:
        """Rows of one paragraph as its first one with all their texts."""
        tail = F.array_join(F.transform(F.slice(rows, F.lit(2), F.size(rows)), lambda r: r["text"]), " ")
        joined = F.when(F.size(rows) == 1, head["text"]).otherwise(F.concat_ws(" ", T.rstrip(head["text"]), tail))
        return F.struct(head["pos"].alias("pos"), joined.alias("text"), *[head[c].alias(c) for c in rest])

    ends = F.concat(F.slice("_s", F.lit(2), F.size("_s")), F.array(F.size("_r") + 1))
    parts = F.zip_with("_s", ends, lambda a, b: cell(F.slice("_r", a, b - a), F.col("_r")[a - 1]))
    cells = F.when(F.size("_s") == 1, F.array(cell(F.col("_r"), F.col("_head")))).otherwise(parts)
    cut = runs.withColumn("_s", F.when(odd, walked).otherwise(F.array(F.lit(1))))
    return cut.select("doc_id", cells.alias("_c")).select("doc_id", F.inline_outer("_c")).select(*columns)


def _islands(rows: DataFrame, columns: list[str], piece: Callable[[Column], Column]) -> DataFrame:
    """Each row with ``_start`` and those up to the next one as one row: the first one's columns, texts joined by a space.

    ``piece`` makes the texts that follow the first ready to be joined; the first one loses its white space at the end.
    """
    numbered = rows.withColumn("_island", F.sum(F.col("_start").cast("int")).over(by_doc()))
    rest = [c for c in columns if c not in ("doc_id", "text")]
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"])
    joined = numbered.groupBy("doc_id", "_island").agg(
        F.min_by(F.struct(*rest, F.col("text").alias("_head")), "pos").alias("_first"), F.count(F.lit(1)).alias("_n"), texts.alias("_texts"))
    tail = F.transform(F.slice("_texts", F.lit(2), F.col("_n").cast("int") - 1), piece)
    text = F.when(F.col("_n") == 1, F.col("_first._head")).otherwise(
        F.concat_ws(" ", T.rstrip(F.col("_first._head")), F.array_join(tail, " ")))
    return joined.withColumn("text", text).select("doc_id", "_first.*", "text").select(*columns)


def drop_consecutive_duplicates(blocks: DataFrame) -> DataFrame:
    """Q21: a paragraph equal (after squashing) to the paragraph right before it."""
    norm = T.squash(F.col("text"))
    keyed = blocks.withColumn("_norm", F.when(F.col("type") == "paragraph", norm))
    repeat = F.col("_norm").eqNullSafe(F.lag("_norm").over(by_doc())) & F.col("_norm").isNotNull()
    return keyed.withColumn("_repeat", repeat).filter(~F.col("_repeat")).drop("_norm", "_repeat")
