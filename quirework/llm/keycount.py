"""Counting 64-bit keys over a whole corpus and telling every document its keys' counts.

Rows are dealt into chunks. A chunk sends each of its distinct keys once, with its weights, packed
by ranges of the key space (buckets); a bucket sums them and answers every chunk in the order of
its keys; the chunk takes its keys from its rows again and reads the answers beside them. So a key
that occurs in a third of all rows is one entry per chunk, and no count is held by the driver or
by every task.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.shared import partitions

#: A chunk's rows -> its distinct keys in rising order, and one weight array per count.
Extract = Callable[[pa.Table], tuple[np.ndarray, list[np.ndarray]]]

_CHUNK_BYTES = 2 << 20
_BUCKET_KEYS = 1 << 20


def pack(counts: np.ndarray) -> bytes:
    """Counts as bytes; those of 255 and more follow in full."""
    counts = counts.astype(np.uint64)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, dtype=np.uint8, count=n).astype(np.uint64)
    counts[counts == 255] = np.frombuffer(data, dtype=np.uint64, offset=n)
    return counts


@dataclass(frozen=True)
class KeyCount:
    """``width``: bytes that a key keeps inside its bucket; keys alike in them count as one."""

    extract: Extract
    n_counts: int
    bits: int
    n_chunks: int
    width: int = 6

    @staticmethod
    def sized(docs: DataFrame, extract: Extract, n_counts: int, *, keys_per_byte: float, width: int = 6) -> KeyCount:
        """Chunks and buckets in proportion to the bytes of text, two for each partition at least."""
        n = partitions(docs.sparkSession)
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(2 * n, total * keys_per_byte / _BUCKET_KEYS)
        return KeyCount(extract, n_counts, min(24, math.ceil(math.log2(buckets))), max(2 * n, math.ceil(total / _CHUNK_BYTES)), width)

    def chunked(self, docs: DataFrame, by: Column) -> DataFrame:
        """``docs`` dealt out by a chunk of ``by``: counting and telling read the same shuffle."""
        chunk = F.pmod(F.xxhash64(by), F.lit(self.n_chunks)).cast("int")
        return docs.select(chunk.alias("_chunk"), "*").repartition(partitions(docs.sparkSession), "_chunk")

    def answers(self, chunked: DataFrame) -> DataFrame:
        """(_chunk, bucket, n, c0, c1, ...): the packed counts of a chunk's n keys in a bucket."""
        extract, bits, width, m = self.extract, self.bits, self.width, self.n_counts
        names = [f"c{i}" for i in range(m)]

        def ask(table: pa.Table) -> pa.Table:
            chunk = table.column("_chunk")[0].as_py()
            keys, weights = extract(table)
            edges = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            low = (keys << np.uint64(bits)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :width]
            used = np.flatnonzero(np.diff(edges))
            spans = [(b, edges[b], edges[b + 1]) for b in used]
            return pa.table({
                "_chunk": pa.array([chunk] * len(spans), pa.int32()),
                "bucket": pa.array(used, pa.int32()),
                "keys": pa.array([low[s:e].tobytes() for _, s, e in spans], pa.binary()),
                **{c: pa.array([pack(w[s:e]) for _, s, e in spans], pa.binary()) for c, w in zip(names, weights, strict=True)},
            })

        def total(table: pa.Table) -> pa.Table:
            raw = table.column("keys").to_pylist()
            sizes = [len(r) // width for r in raw]
            keys = np.zeros((sum(sizes), 8), dtype=np.uint8)
            keys[:, :width] = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(-1, width)
            found, where = np.unique(keys.view(">u8").ravel().astype(np.uint64), return_inverse=True)
            cuts = np.cumsum([0, *sizes])
            out = {"_chunk": table.column("_chunk"), "bucket": table.column("bucket"), "n": pa.array(sizes, pa.int32())}
            for c in names:
                w = np.concatenate([unpack(x, k) for x, k in zip(table.column(c).to_pylist(), sizes, strict=True)])
                sums = np.bincount(where, weights=w.astype(np.float64), minlength=len(found)).astype(np.uint64)[where]
                out[c] = pa.array([pack(sums[s:e]) for s, e in zip(cuts, cuts[1:])], pa.binary())
            return pa.table(out)

        binary = ", ".join(f"{c} binary" for c in names)
        asked = chunked.groupBy("_chunk").applyInArrow(ask, f"_chunk int, bucket int, keys binary, {binary}")
        return asked.groupBy("bucket").applyInArrow(total, f"_chunk int, bucket int, n int, {binary}")

    def tell(self, chunked: DataFrame, answers: DataFrame, use: Callable[[pa.Table, np.ndarray, list[np.ndarray]], pa.Table], schema: str) -> DataFrame:
        """``use(rows of a chunk, its keys, their counts)`` for every chunk."""
        extract, m = self.extract, self.n_counts

        def read(left: pa.Table, right: pa.Table) -> pa.Table:
            right = right.sort_by("bucket")
            sizes = right.column("n").to_pylist()
            counts = [
                np.concatenate([np.zeros(0, np.uint64), *[unpack(x, k) for x, k in zip(right.column(f"c{i}").to_pylist(), sizes, strict=True)]])
                for i in range(m)
            ]
            keys, _ = extract(left)
            return use(left, keys, counts)

        return chunked.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(read, schema)
