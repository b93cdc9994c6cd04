"""Ranked lexical search by Block-Max MaxScore over an inverted index in shards (operator 12).

Documents are dealt into shards, each an inverted file: per term its postings, cut into compressed blocks,
and per block the pairs of term frequency and length that no other of its postings beats, from which the
block's largest contribution follows for any corpus statistics. A query keeps the lists whose bounds
together cannot reach its current threshold out of candidate generation; block maxima of
those lists then reject candidates before a block is decompressed. The shards' best are merged.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.shared import partitions, reliable

#: Runs of everything but the ASCII characters that are neither letters nor digits; the same over UTF-8 bytes.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Bytes of text above which its terms are counted one by one.
_LONG = 4 << 20
#: Postings of a block, documents of a window, postings that a search keeps decompressed.
_BLOCK, _WINDOW, _KEEP = 64, 2048, 4_000_000
#: Terms of the queries that are sent to the tasks which build the index; with more, all terms are indexed.
_VOCABULARY = 1_000_000
#: Queries that meet a shard at once, and bytes of index that one group is meant to hold.
_QUERIES, _PART_BYTES = 1024, 32 << 20

_INDEX = (
    "shard bigint, n_docs bigint, n_terms bigint, ids binary, lengths binary, terms binary, dfs binary, blocks binary, "
    "places binary, sky binary, sky_ends binary, body binary")


def terms_of(text: Column) -> Column:
    """Distinct terms of a text, with A-Z lower-cased; none for null."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), F.lit(0))
    lower = F.transform(found, lambda t: F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.array_distinct(lower)


def counted(text: str | None) -> tuple[int, Counter]:
    raw = (text or "").encode().lower()  # bytes: A-Z only
    if len(raw) > _LONG:
        counts = Counter(m.group() for m in _TERM_BYTES.finditer(raw))
        return counts.total(), counts
    found = _TERM_BYTES.findall(raw)
    return len(found), Counter(found)


class _Shard:
    """Postings as they come, and their inverted file."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.ids, self.lengths, self.sizes = array("q"), array("q"), array("q")
        self.term, self.tf = array("q"), array("q")
        self.bytes = 0

    def add(self, doc: int, text: str | None, wanted: frozenset | None) -> None:
        n, counts = counted(text)
        self.bytes += len(text or "")
        if not n:
            return
        if wanted is not None:
            counts = {t: k for t, k in counts.items() if t in wanted}
        numbers = self.numbers
        self.ids.append(doc)
        self.lengths.append(n)
        self.sizes.append(len(counts))
        self.term.extend([numbers.setdefault(t, len(numbers)) for t in counts])
        self.tf.extend(counts.values())

    def row(self, shard: int) -> dict:
        ids, lengths = (np.frombuffer(x, dtype=np.int64) if x else np.zeros(0, np.int64) for x in (self.ids, self.lengths))
        by_id = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), dtype=np.int64)
        place[by_id] = np.arange(len(ids))
        names = sorted(self.numbers)
        rank = np.zeros(len(names), dtype=np.int64)
        rank[[self.numbers[t] for t in names]] = np.arange(len(names))
        doc = np.repeat(place, np.array(self.sizes, dtype=np.int64))
        term, tf = rank[np.array(self.term, dtype=np.int64)], np.array(self.tf, dtype=np.int64)
        order = np.lexsort((doc, term))
        doc, term, tf = doc[order], term[order], tf[order]
        length = lengths[by_id]
        dfs = np.bincount(term, minlength=len(names))
        starts = np.cumsum([0, *dfs])
        places, sky, sky_ends, body, size = [], [], [], [], 0
        n_blocks = -(-dfs // _BLOCK)
        for t in range(len(names)):
            for lo in range(starts[t], starts[t + 1], _BLOCK):
                hi = min(lo + _BLOCK, starts[t + 1])
                d, f = doc[lo:hi], tf[lo:hi]
                gaps = np.diff(d, prepend=d[:1])
                parts = [x.astype(np.uint8 if x.max() < 256 else np.uint32) for x in (gaps, f)]
                best = 0
                # In rising length, only a larger frequency than all before can contribute more.
                for n, k in sorted(zip(length[d].tolist(), (-f).tolist())):
                    if -k > best:
                        best = -k
                        sky.append((best, n))
                sky_ends.append(len(sky))
                places.append((d[0], d[-1], size, hi - lo, parts[0].itemsize, parts[1].itemsize))
                body += [p.tobytes() for p in parts]
                size += sum(p.nbytes for p in parts)
        packed = lambda x, w: np.array(x, dtype=np.int64).reshape(-1, w).tobytes()
        return {
            "shard": shard, "n_docs": len(ids), "n_terms": int(lengths.sum()), "ids": ids[by_id].tobytes(), "lengths": length.tobytes(),
            "terms": b"\n".join(names), "dfs": packed(dfs, 1), "blocks": packed(np.cumsum([0, *n_blocks]), 1), "places": packed(places, 6),
            "sky": packed(sky, 2), "sky_ends": packed(sky_ends, 1), "body": b"".join(body)}


def _indexer(wanted, shard_rows: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, number, shard = wanted.value, TaskContext.get().partitionId() << 32, _Shard()
        names = [c.split()[0] for c in _INDEX.split(", ")]

        def done() -> pa.RecordBatch:
            row = shard.row(number)
            types = [pa.int64()] * 3 + [pa.binary()] * (len(names) - 3)
            return pa.RecordBatch.from_arrays([pa.array([row[c]], t) for c, t in zip(names, types, strict=True)], names)

        for batch in batches:
            for start in range(0, len(batch), 256):
                rows = batch.slice(start, 256)
                for doc, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                    shard.add(doc, text, terms)
                    if len(shard.ids) >= shard_rows or shard.bytes >= shard_bytes:
                        yield done()
                        number, shard = number + 1, _Shard()
        if shard.ids:
            yield done()

    return run


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for terms, dfs in zip(batch.column("terms").to_pylist(), batch.column("dfs").to_pylist(), strict=True):
            if terms:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms.decode().split("\n")), pa.array(np.frombuffer(dfs, dtype=np.int64))], ["term", "df"])


class _Index:
    """A shard opened for search; blocks are decompressed when asked for and kept within a bound."""

    def __init__(self, row: dict, n_docs: int, n_terms: int) -> None:
        ints = lambda c, w=1: np.frombuffer(row[c], dtype=np.int64).reshape(-1, w) if w > 1 else np.frombuffer(row[c], dtype=np.int64)
        self.ids, self.body = ints("ids"), row["body"]
        self.blocks, self.places = ints("blocks"), ints("places", 6)
        self.at = {t: i for i, t in enumerate(row["terms"].decode().split("\n"))} if row["terms"] else {}
        self.dampened = 20 * (50 + 50 * ints("lengths") * n_docs // n_terms)
        tf, length = ints("sky", 2).T
        value = (1_000_000_000 * tf) // (1000 * tf + 20 * (50 + 50 * length * n_docs // n_terms))
        ends = ints("sky_ends")
        self.bound = np.maximum.reduceat(value, np.concatenate([[0], ends[:-1]])) if len(ends) else np.zeros(0, np.int64)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.kept = self.unpacked = 0

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's documents and its term's contributions to them, without the weight."""
        found = self.open.get(b)
        if found is None:
            first, _, at, n, wide, deep = self.places[b].tolist()
            gaps = np.frombuffer(self.body, dtype=np.uint8 if wide == 1 else np.uint32, count=n, offset=at)
            tf = np.frombuffer(self.body, dtype=np.uint8 if deep == 1 else np.uint32, count=n, offset=at + n * wide).astype(np.int64)
            doc = first + np.cumsum(gaps.astype(np.int64))
            found = doc, (1_000_000_000 * tf) // (1000 * tf + self.dampened[doc])
            if self.kept >= _KEEP:
                self.open.clear()
                self.kept = 0
            self.open[b] = found
            self.kept += n
            self.unpacked += 1
        return found

    def best(self, terms: list[str], weights: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc ids, scores) of the ``k`` best, highest first, ties by smaller id."""
        lists = []
        for term, w in zip(terms, weights, strict=True):
            t = self.at.get(term)
            if t is not None and w > 0:
                lo, hi = self.blocks[t], self.blocks[t + 1]
                lists.append((w * int(self.bound[lo:hi].max()), w, lo, self.places[lo:hi, 0], self.places[lo:hi, 1], w * self.bound[lo:hi]))
        lists.sort(key=lambda x: x[0])
        upto = np.cumsum([0, *[x[0] for x in lists]]).tolist()
        docs, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for start in range(0, len(self.ids), _WINDOW):
            stop = start + _WINDOW
            # Lists before ``first`` cannot lift a document over the threshold, not even all together.
            first = next((p for p in range(len(lists)) if upto[p + 1] > least), len(lists))
            if first == len(lists):
                break
            sums = np.zeros(_WINDOW, dtype=np.int64)
            for _, w, lo, heads, tails, _ in lists[first:]:
                for b in range(int(np.searchsorted(tails, start)), int(np.searchsorted(heads, stop))):
                    doc, value = self.block(lo + b)
                    if doc[0] >= start and doc[-1] < stop:
                        sums[doc - start] += w * value
                    else:
                        inside = slice(*np.searchsorted(doc, (start, stop)))
                        sums[doc[inside] - start] += w * value[inside]
            at = np.flatnonzero(sums)
            at = at[sums[at] + upto[first] > least]
            for p in range(first - 1, -1, -1):
                if not len(at):
                    break
                _, w, lo, heads, tails, bounds = lists[p]
                doc = at + start
                b = np.searchsorted(tails, doc)
                may = np.zeros(len(at), dtype=np.int64)
                inside = b < len(tails)
                inside[inside] = heads[b[inside]] <= doc[inside]
                may[inside] = bounds[b[inside]]
                stay = sums[at] + may + upto[p] > least
                at, b, inside = at[stay], b[stay], inside[stay]
                for one in np.unique(b[inside]).tolist():
                    have, value = self.block(lo + one)
                    mine = at[b == one]
                    where = np.searchsorted(have, mine + start)
                    where[where == len(have)] = 0
                    hit = have[where] == mine + start
                    sums[mine[hit]] += w * value[where[hit]]
            at = at[sums[at] > least]
            if len(at):
                docs, scores = np.concatenate([docs, at + start]), np.concatenate([scores, sums[at]])
                order = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[order], scores[order]
                least = int(scores[-1]) if len(scores) == k else 0
        return self.ids[docs], scores


def _searcher(n_docs: int, n_terms: int, k: int):
    def run(shards: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[list, np.ndarray, np.ndarray, int]] = []
        queries = [q for block in asked.column("queries").to_pylist() for q in block]
        for row in shards.to_pylist():
            index = _Index(row, n_docs, n_terms)
            for q in queries:
                docs, scores = index.best([t["term"] for t in q["terms"]], [t["w"] for t in q["terms"]], k)
                out.append((list(repeat(q["item_id"], len(docs))), docs, scores, row["shard"]))
        none = np.zeros(0, np.int64)
        return pa.table({
            "item_id": pa.array([i for o in out for i in o[0]], pa.int64()),
            "shard": pa.array([o[3] for o in out for _ in o[0]], pa.int64()),
            "doc_id": pa.array(np.concatenate([none, *[o[1] for o in out]])), "score": pa.array(np.concatenate([none, *[o[2] for o in out]]))})

    return run


def ranked_search(docs: DataFrame, queries: DataFrame, *, k: int = 50, shard_rows: int = 8192, shard_bytes: int = 32 << 20) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item of ``queries`` (item_id bigint, text) the ``k`` best of ``docs`` (doc_id bigint, text).

    A term's weight is floor(1000 ln((2N+2)/(2df+1))); a document adds weight * ((10^9 tf) div (1000 tf + 20 m)) for each of the
    item's terms, m being 50 + (50 n N) div L; all but the weight in 64-bit integers. Only scores above 0 are listed, ties by smaller doc_id.

    Rows without doc_id or item_id take no part; a null or empty text has no term. Each row of ``docs`` is a document, repeated
    or not; rows of one item_id are one item with all their terms. Other columns are ignored. Empty tables give an empty result.

    A shard holds at most ``shard_rows`` documents and about ``shard_bytes`` of text (or one longer text). Queries meet shards in blocks of about a
    thousand. Up to a million distinct terms of the queries are sent to the tasks, which then index those only; beyond that they index all.
    The shards' best are merged in two steps, so that no task sees the lists of all shards.
    """
    spark = docs.sparkSession
    asked = queries.filter("item_id IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), F.explode(terms_of(F.col("text"))).alias("term")).distinct()
    words = asked.select("term").distinct()
    few = words.count() <= _VOCABULARY
    wanted = spark.sparkContext.broadcast(frozenset(r["term"].encode() for r in words.toLocalIterator()) if few else None)
    index = reliable(docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_indexer(wanted, shard_rows, shard_bytes), _INDEX))
    total = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l"), F.count(F.lit(1)).alias("shards"), F.sum(F.octet_length("body")).alias("bytes")).first()
    n, l, shards = total["n"] or 0, max(1, total["l"] or 0), total["shards"]
    dfs = index.select("terms", "dfs").mapInArrow(_document_counts, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("bigint")
    weighed = asked.join(dfs.select("term", weight.alias("w")), "term")

    items = asked.select("item_id").distinct().count()
    blocks, parts = max(1, -(-items // _QUERIES)), max(1, min(shards, max(2 * partitions(spark), (total["bytes"] or 0) // _PART_BYTES)))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    item = weighed.groupBy("item_id").agg(F.collect_list(F.struct("term", "w")).alias("terms"))
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block")
    right = item.groupBy(block).agg(F.collect_list(F.struct("item_id", "terms")).alias("queries")).select(each(parts).alias("part"), "block", "queries")
    left = index.select(F.pmod(F.xxhash64("shard"), F.lit(parts)).cast("int").alias("part"), each(blocks).alias("block"), *[c.split()[0] for c in _INDEX.split(", ")])
    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(
        _searcher(n, l, k), "item_id bigint, shard bigint, doc_id bigint, score bigint")

    order = [F.desc("score"), F.asc("doc_id")]
    step = F.pmod(F.xxhash64("shard"), F.lit(max(1, int(shards ** 0.5))))
    some = found.withColumn("_rank", F.row_number().over(Window.partitionBy("item_id", step).orderBy(*order))).filter(F.col("_rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
