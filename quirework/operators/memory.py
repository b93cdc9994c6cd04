"""Translation memory and batch outputs as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.config import DEFAULTS, Settings
from quirework.functions import text as T
from quirework.operators.ordered import first_per_key


def memory_key(text: Column, model: str, temperature: float, target: str) -> Column:
    """Digest of model, temperature, target language and text."""
    head = "\x1f".join((model, f"{temperature:.6f}", target, ""))
    return F.sha2(F.concat(F.lit(head), text), 256)


def _key(text: Column, cfg: Settings) -> Column:
    return memory_key(text, cfg.memory_model, cfg.memory_temperature, cfg.default_target)


def lookup(segments: DataFrame, memory: DataFrame, as_of: Column, cfg: Settings = DEFAULTS,
           salts: int = 1) -> DataFrame:
    """J2 + J4: ``translation`` from memory (null = miss), freshest entry within its life time.

    Both sides are reduced to one row per key first, so a line repeated in a third of
    all documents asks the memory once; only its digest is then joined back.
    """
    fresh = memory.filter(
        (F.col("stored_at") > as_of - F.make_dt_interval(days=F.lit(cfg.memory_ttl_days)))
        & (F.coalesce("translation", F.lit("")) != "")
    ).groupBy("key").agg(F.max_by("translation", "stored_at").alias("translation"))
    keyed = segments.withColumn(
        "key", F.when(T.has_text(F.col("text")), _key(F.col("text"), cfg))
    )
    asked = keyed.filter(F.col("key").isNotNull()).select("key").distinct()
    found = asked.join(fresh, "key")
    return _join_back(keyed, found, salts)


def _join_back(rows: DataFrame, found: DataFrame, salts: int = 1) -> DataFrame:
    """Left join on a digest.

    AQE splits the rows of a hot digest over tasks; with AQE off, ``salts`` copies of the
    found side do the same. Blank rows have no digest: they are spread over keys that nothing has.
    """
    spread = F.xxhash64(*[c for c in rows.columns if c not in ("key", "text")])
    own = F.coalesce("key", F.concat(F.lit("blank "), F.pmod(spread, F.lit(4096)).cast("string")))
    rows, found = rows.withColumn("_key", own), found.withColumnRenamed("key", "_key")
    if salts <= 1:
        return rows.join(found, "_key", "left").drop("_key")
    salted = rows.withColumn("_salt", F.pmod(spread, F.lit(salts)))
    copies = found.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return salted.join(copies, ["_key", "_salt"], "left").drop("_salt", "_key")


def entries_to_store(done: DataFrame, memory: DataFrame | None, stored_at: Column, cfg: Settings = DEFAULTS) -> DataFrame:
    """New memory rows: not blank, not equal to their source, one per key."""
    text, out = F.col("text"), F.col("translation")
    rows = done.filter(T.has_text(text) & T.has_text(out) & (out != text)).select(
        _key(text, cfg).alias("key"), out.alias("translation")
    )
    once = rows.groupBy("key").agg(F.min("translation").alias("translation")).withColumn("stored_at", stored_at)
    return once if memory is None else once.join(memory.select("key"), "key", "left_anti")


def recombine(looked_up: DataFrame, translated: DataFrame) -> DataFrame:
    """Hits kept, misses filled by key, blank segments stay as they are."""
    fresh = translated.groupBy("key").agg(F.min("translation").alias("_new"))
    return _join_back(looked_up, fresh).withColumn(
        "translation", F.coalesce("translation", "_new", F.when(F.col("key").isNull(), F.col("text")))
    ).drop("_new")


def misses(looked_up: DataFrame) -> DataFrame:
    """Distinct texts still to translate."""
    return looked_up.filter(F.col("key").isNotNull() & F.col("translation").isNull()).groupBy("key").agg(
        F.min("text").alias("text")
    )


def merge_batch_outputs(batches: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segment translations, usage per document, errors of missing or uneven batches)."""
    keys = ["doc_id", "batch_id"]
    uneven = F.size("indices") != F.size("translations")
    # A queue may deliver a batch again: one output per batch, an even one where there is any.
    outputs = first_per_key(outputs.select(*keys, "indices", "translations", "usage_tokens"), keys, [uneven, F.xxhash64("indices", "translations"), F.col("usage_tokens")])
    good = outputs.filter(~uneven).select(
        "doc_id", F.inline(F.arrays_zip(F.col("indices").alias("segment_id"), F.col("translations").alias("translation")))
    ).toDF("doc_id", "segment_id", "translation")
    usage = outputs.groupBy("doc_id").agg(F.sum(F.coalesce("usage_tokens", F.lit(0))).alias("usage_tokens"))
    missing = batches.select(*keys).join(outputs.select(*keys), keys, "left_anti").withColumn("error", F.lit("missing"))
    bad = outputs.filter(uneven).select(*keys, F.lit("length_mismatch").alias("error"))
    return good, usage, missing.unionByName(bad)


def usage_or_estimate(usage: DataFrame, estimate: DataFrame) -> DataFrame:
    """M2: reported tokens, or the document estimate where none were reported."""
    return estimate.join(usage, "doc_id", "left").select(
        "doc_id",
        F.when(F.coalesce("usage_tokens", F.lit(0)) > 0, F.col("usage_tokens")).otherwise(F.col("tokens")).alias("tokens"),
    )


def align_by_position(left: DataFrame, right: DataFrame, filler: str = "\u00a0") -> DataFrame:
    """Source and target side by side, the shorter side padded."""
    a = left.select("doc_id", "pos", F.col("text").alias("source"))
    b = right.select("doc_id", "pos", F.col("text").alias("target"))
    return a.join(b, ["doc_id", "pos"], "full").na.fill(filler, ["source", "target"])
