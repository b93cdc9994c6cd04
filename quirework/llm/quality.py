"""Quality classifier on random-indexing word vectors (operator 8).

Every word has a sparse random index vector; a word's vector is the sum of the index vectors of
the words around it. A document is the mean and spread of its words' vectors and of the vectors of their
written shapes. A two-layer network in numpy scores it; a temperature, fitted on rows that the
network did not train on, makes the scores probabilities.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from quirework.llm.words import mix, word_spans

_SLOTS = 1 << 15
_DIM = 48
_NONZERO = 4
_REACH = (-2, -1, 1, 2)
#: Rows without which nothing is learned.
_LEAST = 10

# Kinds of bytes whose presence makes a word's shape.
_KIND = np.zeros(256, dtype=np.uint16)
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 4
_KIND[128:] = 8
for _chars, _bit in ((b".,;:'", 16), (b"!?", 32), (b"#$%&*|<>=+~^_\\", 64), (b"@/()[]{}\"-", 128)):
    _KIND[list(_chars)] = _bit
_SHAPES = 512
#: Numbers of a pooled text.
WIDTH = 3 * _DIM + 3
#: Ranges of slots that are added up apart.
_RANGES = 64
#: Words whose vectors are held at once.
_POOL = 1 << 14


def index_vectors(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the nonzero entries of n sparse ternary vectors, from a hash of their number."""
    each = mix(np.arange(n, dtype=np.uint64)[:, None] * np.uint64(_NONZERO) + np.arange(_NONZERO, dtype=np.uint64) + np.uint64(seed << 32))
    return (each % np.uint64(_DIM)).astype(np.int64), np.where(each >> np.uint64(63), 1.0, -1.0)


def _dense(n: int, seed: int) -> np.ndarray:
    places, signs = index_vectors(n, seed)
    out = np.zeros((n, _DIM), dtype=np.float32)
    np.add.at(out, (np.arange(n)[:, None], places), signs)
    return out / np.sqrt(_NONZERO).astype(np.float32)


_SHAPE_VECTORS = _dense(_SHAPES, 2)


@dataclass
class Words:
    """The words of some texts: slot of the hash, shape, and borders of the texts."""

    slot: np.ndarray
    shape: np.ndarray
    cuts: np.ndarray


def read_words(texts: pa.Array) -> Iterator[Words]:
    for part, hashes, starts, ends, cuts in word_spans(texts):
        if len(hashes) == 0:
            yield Words(np.zeros(0, np.int32), np.zeros(0, np.int16), cuts)
            continue
        bits = np.bitwise_or.reduceat(np.append(_KIND[part], 0), np.stack([starts, ends], 1).ravel())[::2]
        same = np.zeros(len(hashes), dtype=np.int16)
        same[1:] = hashes[1:] == hashes[:-1]
        first = cuts[:-1][cuts[:-1] < len(hashes)]
        same[first] = 0
        yield Words((hashes & np.uint64(_SLOTS - 1)).astype(np.int32), ((bits & 255).astype(np.int16) + 256 * same).astype(np.int16), cuts)


def context_sums(sample: Iterable[Words]) -> np.ndarray:
    """By slot, the summed index vectors of the words at most two places away."""
    places, signs = index_vectors(_SLOTS, 1)
    total = np.zeros(_SLOTS * _DIM)
    for w in sample:
        text = np.repeat(np.arange(len(w.cuts) - 1), np.diff(w.cuts))
        for step in _REACH:
            a, b = (w.slot[:-step], w.slot[step:]) if step > 0 else (w.slot[-step:], w.slot[:step])
            inside = text[abs(step):] == text[: -abs(step)] if len(text) > abs(step) else np.zeros(0, bool)
            a, b = a[: len(inside)][inside], b[: len(inside)][inside]
            for k in range(_NONZERO):
                np.add.at(total, a * _DIM + places[b, k], signs[b, k])
    return total.reshape(_SLOTS, _DIM)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Sums made unit length; a slot that no text has keeps its own index vector."""
    size = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.where(size > 0, sums / np.maximum(size, 1e-9), _dense(_SLOTS, 1)).astype(np.float32)


def corpus_vectors(docs: DataFrame) -> np.ndarray:
    """Word vectors over all texts: every task sums its own, ranges of slots are added up on Spark, and one table of slots comes to the driver."""
    step = _SLOTS // _RANGES

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = context_sums(w for batch in batches for w in read_words(batch.column(0))).astype(np.int64)
        for r in range(_RANGES):
            if (own := sums[r * step: (r + 1) * step]).any():
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["range", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(step * _DIM, dtype=np.int64)
        for one in table.column("sums"):
            total += np.frombuffer(one.as_buffer(), dtype=np.int64)
        return pa.table({"range": table.column("range").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    shape, sums = "range int, sums binary", np.zeros((_SLOTS, _DIM))
    # In two steps: no task adds up the parts of more than about a square root of all.
    parts = docs.select("text").mapInArrow(part, shape).withColumn("deal", F.pmod(F.xxhash64("sums"), F.lit(16)))
    some = parts.groupBy("range", "deal").applyInArrow(lambda t: add(t.select(["range", "sums"])), shape)
    for row in some.groupBy("range").applyInArrow(add, shape).collect():
        sums[row["range"] * step: (row["range"] + 1) * step] = np.frombuffer(row["sums"], dtype=np.int64).reshape(step, _DIM)
    return word_vectors(sums)


def pooled(w: Words, vectors: np.ndarray) -> np.ndarray:
    """Per text: mean word vector, mean and spread of shape vectors, size and share of repeated neighbours.

    Only the vectors of a run of texts of about ``_POOL`` words, or of one text if that is longer, are held at once.
    """
    n = np.diff(w.cuts)
    out = np.zeros((len(n), WIDTH), dtype=np.float32)
    first = 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(w.cuts, w.cuts[first] + _POOL, "right")) - 1)
        lo, hi = w.cuts[first], w.cuts[last]
        full = first + np.flatnonzero(n[first:last])
        first = last
        if not len(full):
            continue
        at = w.cuts[full] - lo
        words, shapes = vectors[w.slot[lo:hi]], _SHAPE_VECTORS[w.shape[lo:hi]]
        size = n[full, None].astype(np.float32)
        out[full, :_DIM] = np.add.reduceat(words, at) / size
        mean = np.add.reduceat(shapes, at) / size
        out[full, _DIM: 2 * _DIM] = mean
        out[full, 2 * _DIM: 3 * _DIM] = np.sqrt(np.maximum(np.add.reduceat(shapes * shapes, at) / size - mean * mean, 0))
        out[full, -3] = np.log1p(n[full]) / 10
        out[full, -2] = np.add.reduceat((w.shape[lo:hi] >> 8).astype(np.float32), at) / n[full]
    out[:, -1] = n == 0
    return out


@dataclass
class Network:
    """Pooled vector -> hidden layer -> log-odds, over ``temperature``."""

    vectors: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.center) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def scores(self, texts: pa.Array) -> np.ndarray:
        z = [self.logits(pooled(w, self.vectors)) for w in read_words(texts)]
        return 1 / (1 + np.exp(-np.clip(np.concatenate([np.zeros(0), *z]) / self.temperature, -30, 30)))


def train(texts: pa.Array, labels: np.ndarray, **more: int) -> Network:
    """``learn`` from texts that are at hand, with word vectors of their own."""
    words = list(read_words(texts))
    vectors = word_vectors(context_sums(words))
    return learn(np.concatenate([np.zeros((0, WIDTH), np.float32), *[pooled(w, vectors) for w in words]]), labels, vectors, **more)


def learn(x: np.ndarray, labels: np.ndarray, vectors: np.ndarray, *, hidden: int = 32, epochs: int = 60, seed: int = 7) -> Network:
    """Fit on four fifths of the rows (pooled texts), and the temperature on the rest.

    Without rows, or with one label only, every score is the smoothed share of label 1.
    """
    x, y = x.astype(np.float64), np.asarray(labels, dtype=np.float64)
    share = (y.sum() + 1) / (len(y) + 2)
    width = x.shape[1]
    rng = np.random.default_rng(seed)
    net = Network(vectors, x.mean(0) if len(x) else np.zeros(width), np.maximum(x.std(0), 1e-3) if len(x) else np.ones(width),
                  rng.normal(0, np.sqrt(2 / width), (width, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(share / (1 - share))))
    if len(y) < _LEAST or y.min() == y.max():
        return net
    net.w2 = rng.normal(0, np.sqrt(1 / hidden), hidden)
    held = np.arange(len(y)) % 5 == 4
    xs, ys = (x[~held] - net.center) / net.scale, y[~held]
    weights = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first, second = [np.zeros_like(p) for p in weights], [np.zeros_like(p) for p in weights]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(ys))
        for s in range(0, len(order), 128):
            rows = order[s: s + 128]
            pre = xs[rows] @ weights[0] + weights[1]
            h = np.maximum(pre, 0)
            err = (1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3], -30, 30))) - ys[rows]) / len(rows)
            back = np.outer(err, weights[2]) * (pre > 0)
            grads = [xs[rows].T @ back + 1e-4 * weights[0], back.sum(0), h.T @ err + 1e-4 * weights[2], np.array([err.sum()])]
            step += 1
            for p, g, a, b in zip(weights, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= 2e-3 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = *weights[:3], float(weights[3][0])
    z, t = net.logits(x[held]), y[held]
    grid = np.geomspace(0.25, 8, 61)
    losses = [np.mean(np.logaddexp(0, z / g) - t * z / g) for g in grid]
    net.temperature = float(grid[int(np.argmin(losses))])
    return net


def crc_fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def fit(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 8000, fit_bytes: int = 48 << 20) -> Network:
    """Learn from at most ``fit_rows`` labelled texts of at most ``fit_bytes`` bytes in all; word vectors from all texts.

    Texts are taken in the order of a hash of their doc_id, of those whose crc32 leaves a remainder other than 2
    by 4; rows of null label or doc_id are passed over, and of several labels of one doc_id the largest counts, of several
    texts the one with the smallest hash, so that repeated rows weigh nothing. A text that does not fit into what is left of the bytes is
    skipped, and the next ones are tried; if that leaves fewer than ten of ten or more, there is no fit and a ValueError says so.

    Texts are summed and pooled where they lie; the driver sees doc_ids, sizes and ``fit_rows`` vectors of ``WIDTH`` numbers.
    """
    spark = docs.sparkSession
    seen = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(crc_fold(F.col("doc_id")) != 2)
    seen = seen.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    drawn = seen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("hash"), F.octet_length(text).alias("bytes"))
    one = rows.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min(F.struct("hash", "bytes", "quality")).alias("s"))
    sizes = one.select(F.xxhash64("doc_id").alias("turn"), "doc_id", "s.*").collect()
    fitting, left = [], fit_bytes
    for r in sorted(sizes):
        if r["bytes"] <= left:
            fitting.append((r["doc_id"], r["hash"], r["quality"]))
            left -= r["bytes"]
    if len(fitting) < _LEAST <= len(sizes):
        raise ValueError(f"of {len(sizes)} labelled texts only {len(fitting)} fit into {fit_bytes} bytes: too few to learn from")
    vectors = corpus_vectors(docs)
    shared = spark.sparkContext.broadcast(vectors)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([np.zeros((0, WIDTH), np.float32), *[pooled(w, shared.value) for w in read_words(batch.column("text"))]])
            flat = pa.array(x.ravel(), pa.float32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * WIDTH, pa.int32()), flat)], ["doc_id", "quality", "x"])

    ids = F.broadcast(spark.createDataFrame(fitting, "doc_id bigint, hash bigint, quality int"))
    sample = rows.join(ids, ["doc_id", "hash"]).select("doc_id", "quality", "text").mapInArrow(pool, "doc_id bigint, quality int, x array<float>")
    # Equal rows of one text pool alike: the first stands for them.
    table = sample.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.first("x").alias("x")).toArrow().sort_by("doc_id")
    table = table.take(pa.array(np.random.default_rng(3).permutation(len(table))))
    x = np.array(table.column("x").to_pylist(), dtype=np.float32).reshape(-1, WIDTH)
    return learn(x, table.column("quality").to_numpy(), vectors)


def score(docs: DataFrame, network: Network, name: str = "score") -> DataFrame:
    """``docs`` with the score of each row's whole text; one pass, no shuffle.

    Null and empty texts get the score of an empty text. Repeated rows get equal scores; other columns pass
    through, one called ``name`` is replaced; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[tuple[pa.Array]]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(shared.value.scores(texts), pa.float64())

    return docs.withColumn(name, arrow_udf(run, "double")(F.col("text")))
