"""What the operators of this package share: checkpoints, row counts and connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share; checkpoints go there.

    Where the setting is absent (a local session in the tests) a folder of this machine is taken.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="llm-checkpoint-"))
    return sc.getCheckpointDir()


def reliable(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def light(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """``df`` materialised, and broadcast if it is found to have at most ``rows`` rows (of a few numbers each)."""
    df = reliable(df)
    return F.broadcast(df) if df.count() <= rows else df


def whole(text: Column) -> Column:
    """The text, a null as the empty one."""
    return F.coalesce(text, F.lit(""))


#: Edges that one task takes in: some ten megabytes.
_TASK_EDGES = 500_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label): each node of the task's edges with the smallest node that they reach from it."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "label"])


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that edges reach, for every row of ``nodes``.

    ``nodes`` has a bigint column node, ``edges`` bigint columns a and b. Edges are dealt into tasks of a bounded
    number; each joins its own and passes on one edge per node. When they fit one task, it joins the rest.
    Until then, in each round a node joins the one of its neighbours and itself that comes first by a hash drawn for the round,
    and edges are drawn between what was joined: a constant share of the nodes goes, chains included, and the edges of a
    dense group go with them. Rounds are cut by checkpoints.
    """
    left = edges.filter("a <> b").select("a", "b")
    into, step = None, 0

    def chained(before: DataFrame | None, last: DataFrame) -> DataFrame:
        if before is None:
            return last
        return before.withColumnRenamed("label", "mid").join(last.withColumnRenamed("node", "mid"), "mid", "left").select("node", F.coalesce("label", "mid").alias("label"))

    while True:
        left = reliable(left)
        n = left.count()
        tasks = -(-n // _TASK_EDGES)
        forest = left.repartition(max(1, tasks)).mapInArrow(_joined, "node bigint, label bigint")
        if tasks <= 1:
            into = chained(into, forest)
            break
        step += 1
        left = reliable(forest.filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")).distinct())
        turn = lambda c: F.struct(F.xxhash64(c, F.lit(step)).alias("h"), c.alias("b"))
        first = left.union(left.select("b", "a")).groupBy("a").agg(F.min(turn(F.col("b"))).alias("t"))
        picked = reliable(first.select(F.col("a").alias("node"), F.when(F.col("t") < turn(F.col("a")), F.col("t.b")).otherwise(F.col("a")).alias("label")))
        ends = [picked.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab"]
        into = reliable(chained(into, picked))
        left = left.join(ends[0], "a").join(ends[1], "b").filter("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    # The smallest node of what was joined names it.
    into = reliable(into)
    least = into.groupBy("label").agg(F.min("node").alias("component"))
    return nodes.join(into.join(least, "label").select("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
