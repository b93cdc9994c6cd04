"""Ordered computations that stay parallel when one key holds a large share of rows.

A plain ``Window.partitionBy(key)`` puts a whole key in one task. ``Sequence``
adds a *chunk*: any expression that never decreases along the order (a date, a
position divided by some size). Windows then run per (key, chunk); what a chunk
needs from the chunks before it travels as one small row per (key, chunk), whose
prefix is taken over chunks only and joined back. The large side is shuffled once
by (key, chunk), and that partitioning also serves the join back.
"""

from __future__ import annotations

import tempfile
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CHUNK = "_chunk"
_PINNED = "_pinned"


@dataclass(frozen=True)
class Sequence:
    """Rows ordered by ``order`` inside ``keys``; ``chunk`` is SQL text, monotone in the order."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunk: str

    @property
    def parts(self) -> list[str]:
        return [*self.keys, _CHUNK]

    def mark(self, df: DataFrame) -> DataFrame:
        return df if _CHUNK in df.columns else df.withColumn(_CHUNK, F.expr(self.chunk))

    def local(self):
        return Window.partitionBy(*self.parts).orderBy(*self.order)

    def across(self):
        return Window.partitionBy(*self.keys).orderBy(_CHUNK)


# kind -> (window/group aggregate, how an earlier result joins a later one)
_FOLDS = {
    "sum": (F.sum, lambda before, here: F.coalesce(before + here, here, before)),
    "max": (F.max, lambda before, here: F.greatest(before, here)),
    "min": (F.min, lambda before, here: F.least(before, here)),
}


def running(df: DataFrame, seq: Sequence, aggs: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Inclusive running aggregates: ``{out: (kind, value)}``.

    Kinds: ``sum``, ``max``, ``min`` and ``last`` (latest non-null value so far).
    """
    marked = seq.mark(df)
    frame = seq.local().rowsBetween(Window.unboundedPreceding, 0)
    before = seq.across().rowsBetween(Window.unboundedPreceding, -1)
    here, totals, prefix, combined = {}, [], [], {}
    for out, (kind, value) in aggs.items():
        if kind == "last":
            here[f"_h_{out}"] = F.last(value, ignorenulls=True).over(frame)
            totals.append(
                F.max_by(value, F.when(value.isNotNull(), F.struct(*seq.order))).alias(f"_t_{out}")
            )
            prefix.append(F.last(f"_t_{out}", ignorenulls=True).over(before).alias(f"_b_{out}"))
            combined[out] = F.coalesce(F.col(f"_h_{out}"), F.col(f"_b_{out}"))
        else:
            fold, join = _FOLDS[kind]
            here[f"_h_{out}"] = fold(value).over(frame)
            totals.append(fold(value).alias(f"_t_{out}"))
            prefix.append(fold(F.col(f"_t_{out}")).over(before).alias(f"_b_{out}"))
            combined[out] = join(F.col(f"_b_{out}"), F.col(f"_h_{out}"))
    chunks = marked.groupBy(*seq.parts).agg(*totals).select(*seq.parts, *prefix)
    return (
        marked.withColumns(here)
        .join(chunks, seq.parts, "left")
        .withColumns(combined)
        .drop(*here, *[f"_b_{out}" for out in aggs], _CHUNK)
    )


def neighbours(
    df: DataFrame,
    seq: Sequence,
    lag: Mapping[str, Column] | None = None,
    lead: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Previous / next row's values, exact across chunk borders."""
    marked = seq.mark(df)
    lag, lead = dict(lag or {}), dict(lead or {})
    key = F.struct(*seq.order)
    w, across = seq.local(), seq.across()
    edges, picked = [], []
    if lag:
        edges.append(F.max_by(F.struct(*[v.alias(o) for o, v in lag.items()]), key).alias("_last"))
        picked.append(F.lag("_last").over(across).alias("_before"))
    if lead:
        edges.append(F.min_by(F.struct(*[v.alias(o) for o, v in lead.items()]), key).alias("_first"))
        picked.append(F.lead("_first").over(across).alias("_after"))
    chunks = marked.groupBy(*seq.parts).agg(*edges).select(*seq.parts, *picked)
    out = marked.withColumns({
        "_rn": F.row_number().over(w),
        **({"_has_next": F.lead(F.lit(True)).over(w)} if lead else {}),
        **{f"_p_{o}": F.lag(v).over(w) for o, v in lag.items()},
        **{f"_n_{o}": F.lead(v).over(w) for o, v in lead.items()},
    }).join(chunks, seq.parts, "left")
    final = {o: F.when(F.col("_rn") > 1, F.col(f"_p_{o}")).otherwise(F.col(f"_before.{o}")) for o in lag}
    final |= {
        o: F.when(F.col("_has_next"), F.col(f"_n_{o}")).otherwise(F.col(f"_after.{o}")) for o in lead
    }
    return out.withColumns(final).drop(
        "_rn", "_has_next", "_before", "_after", _CHUNK,
        *[f"_p_{o}" for o in lag], *[f"_n_{o}" for o in lead],
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """First row per key as one aggregate, so duplicates collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(*keys, "_row.*")


def pinned(df: DataFrame, cols: Mapping[str, Column]) -> DataFrame:
    """Add columns computed exactly once per row.

    A plain projection may be substituted into every later filter and expression that
    names its columns, which multiplies costly parsing. Generated columns are not. They are
    projected before they are generated: Spark takes a generator's output to be as large as its
    input, and a later projection, which drops some of them, for a fraction of that. Without the
    projection a large table is soon estimated small enough to be broadcast. The generator is an outer
    one: before an inner one Spark adds a filter on the size of its array, which computes the array twice.
    """
    fresh = F.array(F.struct(*[v.alias(n) for n, v in cols.items()]))
    kept = [c for c in df.columns if c not in cols]
    return df.select("*", fresh.alias(_PINNED)).select(*kept, F.inline_outer(_PINNED))


def numbered(df: DataFrame, kept: list[Column | str], array: Column | str, at: str, value: str) -> DataFrame:
    """``posexplode`` of an array that is costly to make: made once, for the reason told at ``pinned``."""
    return df.select(*kept, F.posexplode_outer(array).alias(at, value)).filter(F.col(at).isNotNull())


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that ``spark.checkpoint.dir`` names.

    Without one, a local session takes a folder of its own machine; a cluster gets an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quirework-checkpoint-"))
    return df.checkpoint()
