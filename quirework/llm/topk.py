"""Exact top-k by inner product as a Voronoi join (operator 13).

With one more coordinate that makes all data vectors equally long, the largest inner product is the
smallest distance. Pivots cut the space into cells; summaries of the cells (radius, the data nearest to
the pivot) bound how far a group of queries has to look, and a data vector is copied only to the groups for which
the triangle inequality cannot rule it out. Groups are solved on their own and their results merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.shared import reliable

#: Queries and data vectors of one product of matrices.
_ROWS, _COLUMNS = 512, 4096
#: Score of no candidate, below any other.
_NONE = -(2**62) - 1
#: Relative room for rounding in the bounds.
_ROOM = 1e-9

_CELLS = "query boolean, vec_id bigint, v binary, cell int, apart double"


def usable(vector: Column) -> Column:
    """Not null, not empty, no component null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(fine, F.lit(False))


def _kind(largest: int) -> type:
    return next(t for t in (np.int8, np.int16, np.int32, np.int64) if largest <= np.iinfo(t).max)


def _grid(column: pa.Array, scale: float, kind: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).astype(kind).reshape(len(column), -1)


def lifted(x: np.ndarray, square: float, query: bool) -> np.ndarray:
    """With one coordinate more: what data vectors lack in squared length, 0 for queries."""
    x = x.astype(np.float64)
    more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, square - (x * x).sum(1)))
    return np.column_stack([x, more])


def _assign(pivots: np.ndarray, scale: float, kind: type, square: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 4096):
                rows = batch.slice(start, 4096)
                asks = rows.column("query").to_numpy(zero_copy_only=False)
                x = _grid(rows.column("v"), scale, kind)
                points = np.where(asks[:, None], lifted(x, square, True), lifted(x, square, False))
                near = (pivots * pivots).sum(1) - 2 * points @ pivots.T
                cell = near.argmin(1)
                apart = np.sqrt(((points - pivots[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("query"), rows.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(cell.astype(np.int32)), pa.array(apart)],
                    [c.split()[0] for c in _CELLS.split(", ")])

    return run


def _nearest_of_cells(m: int):
    """Of each cell, the ``m`` different ids of a task's data that are nearest to the pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, dict[int, float]] = {}
        for batch in batches:
            cells, ids, apart = (batch.column(c).to_numpy() for c in ("cell", "vec_id", "apart"))
            order = np.lexsort((apart, cells))
            edges = np.flatnonzero(np.diff(cells[order], prepend=-1))
            for lo, hi in zip(edges, [*edges[1:], len(order)]):
                own = best.setdefault(int(cells[order[lo]]), {})
                fresh: set[int] = set()
                for i in order[lo:hi]:
                    if len(fresh) == m:
                        break
                    one, far = int(ids[i]), float(apart[i])
                    fresh.add(one)
                    own[one] = min(far, own.get(one, far))
                best[int(cells[order[lo]])] = dict(sorted(own.items(), key=lambda e: e[1])[:m])
        rows = [(c, i, a) for c, own in best.items() for i, a in own.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())],
            ["cell", "vec_id", "apart"])

    return run


def reach(radius: float, between: np.ndarray, near: dict[int, list[tuple[float, int]]], m: int) -> float:
    """Distance within which every query of a cell has ``m`` different ids: of all cells' nearest, the m-th upper bound."""
    bounds = sorted((radius + between[j] + a, i) for j, some in near.items() for a, i in some)
    seen: set[int] = set()
    for bound, i in bounds:
        seen.add(i)
        if len(seen) == m:
            return bound
    return float("inf")


def grouped(counts: dict[int, int], between: np.ndarray, size: int) -> list[list[int]]:
    """Query cells in groups of about ``size`` queries: from the smallest cell number on, the nearest cells that still fit."""
    left, out = sorted(counts), []
    while left:
        group = [left.pop(0)]
        held = counts[group[0]]
        for c in sorted(left, key=lambda c: (between[group[0], c], c)):
            if held + counts[c] <= size:
                group.append(c)
                held += counts[c]
        left = [c for c in left if c not in set(group)]
        out.append(group)
    return out


def _best(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, id, score) of the ``k`` highest of each row, ties by smaller id; a row's own id is none of them."""
    by_id = np.argsort(ids, kind="stable")
    x, ids = x[by_id], ids[by_id]
    number = np.float64 if exact else np.int64
    rows, picked, scores = ([np.zeros(0, np.int64)] for _ in range(3))
    for lo in range(0, len(q), _ROWS):
        part, mine = q[lo:lo + _ROWS].astype(number), own[lo:lo + _ROWS, None]
        best, names = np.zeros((len(part), 0), np.int64), np.zeros((len(part), 0), np.int64)
        for at in range(0, len(x), _COLUMNS):
            name = ids[at:at + _COLUMNS]
            s = np.where(mine == name, _NONE, (part @ x[at:at + _COLUMNS].T.astype(number)).astype(np.int64))
            if best.shape[1] == k:
                # Ids rise, so an equal score does not displace the k-th best.
                hope = np.flatnonzero((s > best[:, -1:]).any(0))
                s, name = s[:, hope], name[hope]
            # Columns stand in the order of preference among equal scores.
            best, names = np.concatenate([best, s], axis=1), np.concatenate([names, np.broadcast_to(name, s.shape)], axis=1)
            if (n := best.shape[1]) > 4 * k:
                kth = np.partition(best, n - k, axis=1)[:, n - k: n - k + 1]
                above, ties = best > kth, best == kth
                keep = above | ties & (np.cumsum(ties, axis=1) <= k - above.sum(1, keepdims=True))
                where = np.nonzero(keep)[1].reshape(len(part), k)
                best, names = np.take_along_axis(best, where, 1), np.take_along_axis(names, where, 1)
            first = np.argsort(-best, axis=1, kind="stable")[:, :k]
            best, names = np.take_along_axis(best, first, 1), np.take_along_axis(names, first, 1)
        r, c = np.nonzero(best > _NONE)
        for held, more in zip((rows, picked, scores), (r + lo, names[r, c], best[r, c])):
            held.append(more)
    return np.concatenate(rows), np.concatenate(picked), np.concatenate(scores)


def _solve(kind: type, k: int, exact: bool):
    def run(data: pa.Table, asked: pa.Table) -> pa.Table:
        raw = asked.column("q").to_pylist()
        if not len(data) or not raw:
            rows = ids = scores = np.zeros(0, np.int64)
            own = np.zeros(0, np.int64)
        else:
            own = asked.column("own").to_numpy()
            q, x = (np.frombuffer(b"".join(v), dtype=kind).reshape(len(v), -1) for v in (raw, data.column("v").to_pylist()))
            rows, ids, scores = _best(q, own, x, data.column("vec_id").to_numpy(), k, exact)
        return pa.table({
            "query_id": pa.array(own[rows]), "v": pa.array([raw[r] for r in rows], pa.binary()), "vec_id": pa.array(ids), "score": pa.array(scores)})

    return run


def nearest_products(
    vectors: DataFrame, queries: DataFrame, *, k: int = 20, scale: float = 64.0, n_pivots: int = 128, group_queries: int = 2048, shard_rows: int = 32_768,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of ``queries`` the ``k`` of ``vectors`` with the highest integer inner product.

    Both tables have vec_id bigint and embedding (array of numbers); a component x counts as floor(scale * x). Ties go to the
    smaller vec_id, rows of the query's own vec_id are no candidates, and a query with fewer candidates gets them all.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do those that differ in length from
    most of ``vectors`` (of equally frequent lengths the larger stays), nor rows of null vec_id. Repeated rows are
    rows each as data; as queries, rows equal in vec_id and vector are one query, different vectors of one vec_id are
    ranked each for itself. Other columns are ignored; with nothing to search the result is empty. Vectors whose scores could reach 2^62 are an error.

    Pivots are the first ``n_pivots`` data vectors by a hash of vec_id. The driver holds per cell ``k`` + 1 distances and per
    group and cell two bounds: a size fixed by these parameters and the number of groups. Groups hold about ``group_queries`` queries (a larger cell is cut
    into blocks), and a group's data is dealt into shards of ``shard_rows``, so a cell with most of the data is many tasks. On data without
    clusters the bounds rule out little, and every group meets nearly all data: the work is then queries times data.
    """
    spark = vectors.sparkSession

    def clean(table: DataFrame) -> DataFrame:
        return table.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
            F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))

    data, asked = clean(vectors), clean(queries)
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("double"))
    sizes = lambda t: t.select(F.size("v").alias("n"), whole.alias("w")).groupBy("n").agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.array_max(F.transform("w", F.abs))).alias("largest"),
        F.max(F.aggregate("w", F.lit(0.0), lambda a, x: a + x * x)).alias("square"))
    most = sizes(data).orderBy(F.desc("rows"), F.desc("n")).first()
    if most is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    dim = most["n"]
    data, asked = data.filter(F.size("v") == dim), asked.filter(F.size("v") == dim)
    there = sizes(asked).first()
    largest = max(most["largest"], there["largest"] if there else 0)
    if dim * largest * largest >= 2**62:
        raise ValueError("inner products do not fit a long")
    kind, square = _kind(int(largest)), float(most["square"])
    sample = data.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(n_pivots).collect()
    pivots = np.unique(lifted(np.floor(scale * np.array([r["v"] for r in sample]).reshape(-1, dim)), square, False), axis=0)
    between = np.sqrt(np.maximum(0.0, ((pivots[:, None] - pivots[None]) ** 2).sum(2)))

    rows = data.select(F.lit(False).alias("query"), "*").unionByName(asked.select(F.lit(True).alias("query"), "*").distinct())
    cells = reliable(rows.mapInArrow(_assign(pivots, scale, kind, square), _CELLS))
    stored, askers = cells.filter("not query"), cells.filter("query")
    near: dict[int, list[tuple[float, int]]] = {}
    some = stored.select("cell", "vec_id", "apart").mapInArrow(_nearest_of_cells(k + 1), "cell int, vec_id bigint, apart double").groupBy("cell", "vec_id").agg(F.min("apart").alias("apart"))
    first = Window.partitionBy("cell").orderBy("apart", "vec_id")
    for r in some.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k + 1).collect():
        near.setdefault(r["cell"], []).append((r["apart"], r["vec_id"]))
    told = {r["cell"]: (r["n"], r["radius"]) for r in askers.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("radius")).collect()}

    groups = grouped({c: n for c, (n, _) in told.items()}, between, group_queries)
    bounds = []
    for g, members in enumerate(groups):
        lo, hi = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
        for c in members:
            span = told[c][1] + reach(told[c][1], between[c], near, k + 1)
            room = _ROOM * (1 + between[c] + told[c][1])
            lo, hi = np.minimum(lo, between[c] - span - room), np.maximum(hi, between[c] + span + room)
        bounds += [(j, g, float(lo[j]), float(hi[j])) for j in near]
    needs = F.broadcast(spark.createDataFrame(bounds, "cell int, g int, lo double, hi double"))
    needed = stored.join(needs, "cell").filter("apart BETWEEN lo AND hi")
    copies = {r["g"]: r["n"] for r in needed.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    shape = F.broadcast(spark.createDataFrame(
        [(g, c, max(1, -(-sum(told[m][0] for m in members) // group_queries)), max(1, -(-copies.get(g, 0) // shard_rows))) for g, members in enumerate(groups) for c in members],
        "g int, cell int, blocks int, shards int"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    deal = lambda c, *by: F.pmod(F.xxhash64(*by), F.col(c)).cast("int")
    by_group = F.broadcast(shape.select("g", "blocks", "shards").distinct())
    # Copies of one row spread over the shards as well: the place within the cell is part of the hash.
    left = needed.join(by_group, "g").withColumn("shard", deal("shards", F.col("vec_id"), F.col("v"), F.monotonically_increasing_id())).select("g", each("blocks").alias("block"), "shard", "vec_id", "v")
    right = askers.join(shape, "cell").withColumn("block", deal("blocks", F.col("vec_id"), F.col("v"))).select("g", "block", each("shards").alias("shard"), F.col("vec_id").alias("own"), F.col("v").alias("q"))
    keys = ["g", "block", "shard"]
    exact = dim * largest * largest < 2**53
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_solve(kind, k, exact), "query_id bigint, v binary, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id", "v").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
