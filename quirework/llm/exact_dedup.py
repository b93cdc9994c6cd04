"""Exact de-duplication by sorting the contents (operator 5, DataFrame functions only).

Rows are range-partitioned on a short sort key of the text bytes with sampled splitters, sorted
externally in full, and each row is compared whole with its neighbour: a run of equal neighbours
is a group of copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.shared import partitions, whole


def content_sort(docs: DataFrame, *, keep: str = "max", salts: int = 64, share: int = 8) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``docs`` has doc_id bigint and text; other columns are ignored. Texts are equal when their
    bytes are; a null text counts as empty. Of equal texts the row with the largest doc_id stays
    (``keep="min"``: the smallest). A null doc_id ranks below every other; of rows repeated with
    the same doc_id and text one is kept. An empty table gives an empty result.

    The splitters are sampled from the first characters and a hash, so the driver sees a bounded
    number of short keys. A text with more than a ``1 / (share * partitions)`` share of the rows is
    dealt over ``salts`` ranges; there are at most ``share * partitions`` such texts, so the list of
    their hashes is small whatever the input, and so is the table of their runs that joins them up.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    text = whole(F.col("text"))
    rows = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.substring("text", 1, 16).alias("_head"), F.xxhash64("text").alias("_hash"))
    total = docs.count()
    hot = (
        docs.groupBy(F.xxhash64(text).alias("_hash")).agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") * share * n > total).filter("_n > 1").select("_hash", F.lit(True).alias("_hot"))
    )
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(-1)
    key = ["_head", "_hash", "_salt"]
    dealt = rows.join(F.broadcast(hot), "_hash", "left").withColumn("_salt", salt).repartitionByRange(n, *key)

    order = F.desc_nulls_last if keep == "max" else F.asc_nulls_last
    before = Window.partitionBy(*key).orderBy("text", order("doc_id"))
    seen = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = (
        dealt.withColumn("_first", F.coalesce(F.lag("text").over(before) != F.col("text"), F.lit(True)))
        .withColumn("_run", F.count(F.when(F.col("_first"), 1)).over(seen))
        .select("doc_id", *key, "_run", "_first", F.sha2("text", 256).alias("text_sha256"))
    )
    run = Window.partitionBy(*key, "_run")
    runs = runs.withColumns({
        "_keep": F.max(F.when(F.col("_first"), F.col("doc_id"))).over(run),
        "_size": F.count(F.lit(1)).over(run),
    })
    # Runs of one hot text, a few for each salt, meet here; equal digests stand for equal texts only
    # among runs whose texts already share head and hash.
    merged = (
        runs.filter("_salt >= 0 and _first").groupBy("_head", "_hash", "text_sha256")
        .agg((F.max if keep == "max" else F.min)("_keep").alias("_top"), F.sum("_size").alias("_all"))
    )
    out = runs.join(F.broadcast(merged), ["_head", "_hash", "text_sha256"], "left")
    hot_row = F.col("_salt") >= 0
    keep_id = F.when(hot_row, F.col("_top")).otherwise(F.col("_keep"))
    return out.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.when(hot_row, F.col("_all")).otherwise(F.col("_size")).alias("group_size"),
        (F.col("_first") & F.col("doc_id").eqNullSafe(keep_id)).alias("kept"),
        "text_sha256",
    )
