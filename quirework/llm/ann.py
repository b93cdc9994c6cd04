"""Approximate nearest neighbours by a permutation index (operator 9).

A vector is represented by its nearest pivots in order. Inverted files list, for each pivot, the vectors
that have it and at which rank; a query adds up over its own pivots how close the two orders are (the
footrule distance), and the closest vectors are ranked again by their true distance.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.shared import partitions


def usable(vector: Column) -> Column:
    """Neither null nor zero, and every component finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def orders(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """For each vector the numbers of its ``length`` nearest pivots, nearest first, ties by number."""
    square = (pivots * pivots).sum(1) - 2 * x @ pivots.T
    return np.argsort(square, axis=1, kind="stable")[:, :length]


def _search(pivots: np.ndarray, length: int, depth: float, k: int):
    def search(data: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if len(data) and len(queries):
            ids, x = data.column("vec_id").to_numpy(), _matrix(data.column("v"))
            own = orders(x, pivots, length)
            # The inverted file: rows and ranks by pivot.
            by_pivot = np.argsort(own.ravel(), kind="stable")
            row, rank = by_pivot // length, by_pivot % length
            edges = np.searchsorted(own.ravel()[by_pivot], np.arange(len(pivots) + 1))
            take = min(len(x), max(k + 1, math.ceil(depth * len(x))))
            q = _matrix(queries.column("v"))
            for qid, vector, order in zip(queries.column("vec_id").to_pylist(), q, orders(q, pivots, length), strict=True):
                # Less footrule distance is more of this sum over the pivots that both have.
                near = np.zeros(len(x), dtype=np.int32)
                for at, p in enumerate(order):
                    s = slice(edges[p], edges[p + 1])
                    near[row[s]] += length - np.maximum(at, rank[s]).astype(np.int32)
                best = np.argpartition(-near, take - 1)[:take]
                best = best[ids[best] != qid]
                apart = np.sqrt(((x[best] - vector) ** 2).sum(1))
                for i in np.lexsort((ids[best], apart))[:k]:
                    out.append((qid, int(ids[best[i]]), float(apart[i])))
        return pa.table({
            "query_id": pa.array([o[0] for o in out], pa.int64()), "vec_id": pa.array([o[1] for o in out], pa.int64()),
            "score": pa.array([o[2] for o in out], pa.float64())})

    return search


def nearest(
    vectors: DataFrame, queries: DataFrame, *, k: int = 10, n_pivots: int = 256, length: int = 64, depth: float = 0.3,
    shard_rows: int = 32_768, block_rows: int = 4096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest of ``vectors`` by Euclidean distance.

    Both tables have vec_id bigint and embedding (array of numbers). Every usable vector is indexed; only the
    pivots are a sample, the first ``n_pivots`` by a hash of vec_id. Vectors are dealt into shards of about
    ``shard_rows`` and queries into blocks; each block meets each shard, where the ``depth`` share of the
    shard that has the least footrule distance is ranked again, so no query misses a part of the index.
    Scores are distances of the original vectors in double precision; ties go to the smaller vec_id.

    Vectors that are null, zero, hold null or non-finite components or differ in length from
    most pivots take no part, nor do rows of null vec_id. A row with the query's vec_id is not its neighbour. Repeated rows of one
    vec_id each count as a row. Other columns are ignored; with nothing to search the result is empty.
    """
    spark = vectors.sparkSession
    good = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    asked = queries.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    sample = [r["v"] for r in good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n_pivots).collect()]
    sizes = [len(v) for v in sample]
    dim = max(set(sizes), key=lambda n: (sizes.count(n), n)) if sizes else 0
    pivots = np.array([v for v in sample if len(v) == dim], dtype=np.float64).reshape(-1, dim or 1)
    good, asked = good.filter(F.size("v") == dim), asked.filter(F.size("v") == dim)
    n = good.count()
    shards = max(1, min(partitions(spark), n // 1024), math.ceil(n / shard_rows))
    blocks = max(1, math.ceil(asked.count() / block_rows))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    deal = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    left = good.select(deal(shards).alias("shard"), each(blocks).alias("block"), "vec_id", "v")
    right = asked.select(each(shards).alias("shard"), deal(blocks).alias("block"), "vec_id", "v")
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(
        _search(pivots, min(length, max(1, len(pivots))), depth, k), "query_id bigint, vec_id bigint, score double")
    first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
