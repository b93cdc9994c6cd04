"""Connected components of large graphs in few rounds, whatever the length of their chains."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.operators.ordered import cut_lineage

#: Edges that one task joins.
TASK_EDGES = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of a task's edges a, b; the root is the smallest node of its tree."""
    parent: dict[int, int] = {}

    def root(node: int) -> int:
        path = []
        while (up := parent.setdefault(node, node)) != node:
            path.append(node)
            node = up
        parent.update(dict.fromkeys(path, node))
        return node

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(list(map(root, nodes)), pa.int64())], ["node", "root"])


def components(edges: DataFrame, n_edges: int | None = None, task_edges: int | None = None) -> DataFrame:
    """(node, component) for every end of ``edges`` (a, b bigint); a component is named by one of its nodes.

    While there are more edges than a task takes, tasks replace theirs by trees, and every node joins the neighbour, or itself,
    that comes first by a hash drawn for the round: a constant share of the nodes goes in each round, on chains and stars alike.
    The rest is joined by one task. With ``n_edges`` known to be few nothing runs before the result is asked for.
    """
    limit = task_edges or TASK_EDGES
    joined, step = None, 0

    def through(last: DataFrame) -> DataFrame:
        if joined is None:
            return last.select("node", F.col("root").alias("component"))
        met = joined.join(last.select(F.col("node").alias("component"), "root"), "component", "left")
        return met.select("node", F.coalesce("root", "component").alias("component"))

    while True:
        if n_edges is None:
            edges = cut_lineage(edges)
            n_edges = edges.count()
        forest = edges.select("a", "b").repartition(max(1, -(-n_edges // limit))).mapInArrow(_forest, "node bigint, root bigint")
        if n_edges <= limit:
            return through(forest)
        step += 1
        trees = cut_lineage(forest.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
        drawn = lambda c: F.struct(F.xxhash64(c, F.lit(step)).alias("h"), c.alias("to"))
        least = trees.unionByName(trees.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min(drawn(F.col("b"))).alias("m"))
        moved = cut_lineage(least.select(F.col("a").alias("node"), F.when(F.col("m") < drawn(F.col("a")), F.col("m.to")).otherwise(F.col("a")).alias("root")))
        joined = cut_lineage(through(moved))
        to = [moved.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")) for c in "ab"]
        edges = trees.join(to[0], "a").join(to[1], "b").filter("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct()
        n_edges = None
