"""N-gram Jaccard join by rare-first prefix filtering (operator 3).

Word n-grams are ordered rare-first by their frequency in the whole corpus. Two sets that are
similar enough share an n-gram among the first few of each (the prefix); candidates meet there,
pass length, positional and suffix filters and are verified once per pair on the whole sets until
the components are known. Inside a component all pairs are then compared on the whole sets.
Equal sets are one class, which takes part once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.keycount import KeyCount
from quirework.llm.shared import components, light, partitions, reliable
from quirework.llm.words import mix, shingle_hashes, word_spans

_CELLS = 256
_BLOCKS = 64
_LIST_ROWS = 2000
#: Sets and n-grams of one block of a component, and from how many sets on an n-gram is counted by products.
_SPAN_ROWS = 1000
_SPAN_GRAMS = 250_000
_OFTEN = 48
_SHAPE = "doc_id bigint, n bigint, sig binary, prefix array<bigint>, at array<int>, cells binary, grams binary"


def _sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The distinct n-gram hashes of each text, in rising order."""
    for _, words, _, _, cuts in word_spans(texts):
        for s, e in zip(cuts, cuts[1:]):
            yield np.unique(shingle_hashes(words[s:e], n))


def _extract(n: int):
    def extract(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each n-gram of the chunk with the number of different sets that hold it."""
        seen: set[bytes] = set()
        each = []
        for s in _sets(table.column("text"), n):
            if (sig := _signature(s)) not in seen:
                seen.add(sig)
                each.append(s)
        keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *each]), return_counts=True)
        return keys, [counts]

    return extract


def _signature(s: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    other = mix(s ^ np.uint64(0xA0761D6478BD642F))
    return s.sum(dtype=np.uint64).tobytes() + other.sum(dtype=np.uint64).tobytes()


def _least(size: int, num: int, den: int) -> int:
    """The smallest set, and so the smallest overlap, that a set of ``size`` can be similar to."""
    return -(-num * size // den)


def _rank(n: int, num: int, den: int):
    def use(table: pa.Table, keys: np.ndarray, counts: list[np.ndarray]) -> pa.Table:
        rows = []
        for doc_id, s in zip(table.column("doc_id").to_pylist(), _sets(table.column("text"), n), strict=True):
            size = len(s)
            if not size:
                rows.append((doc_id, 0, b"", None, None, None, None))
                continue
            df = counts[0][np.searchsorted(keys, s)]
            length = size - _least(size, num, den) + 1
            prefix = np.lexsort((s, df))[:length]
            # An n-gram of one set only finds no partner; it keeps its place in the prefix.
            at = np.flatnonzero(df[prefix] > 1)
            if len(at):
                cells = np.bincount((s & np.uint64(_CELLS - 1)).astype(np.int64), minlength=_CELLS).astype(np.uint8)
                rows.append((doc_id, size, _signature(s), s[prefix[at]].view(np.int64), at, cells.tobytes(), s.tobytes()))
            else:
                rows.append((doc_id, size, _signature(s), None, None, None, None))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
        names = [c.split()[0] for c in _SHAPE.split(", ")]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return use


def gram_sets(docs: DataFrame, *, n: int, num: int, den: int) -> DataFrame:
    """Per document its set's size, signature, and rare-first prefix; sets come with a prefix only."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Frequencies only order the n-grams: 32 bits within a bucket of about a million keys are enough.
    count = KeyCount.sized(rows, _extract(n), 1, keys_per_byte=1 / 6, width=4)
    chunked = count.chunked(rows, F.struct("doc_id", F.xxhash64("text")))
    return count.tell(chunked, count.answers(chunked), _rank(n, num, den), _SHAPE)


def _need(a: Column, b: Column, num: int, den: int) -> Column:
    """The overlap from which sets of sizes a and b are similar."""
    return F.ceil((a + b) * F.lit(num) / F.lit(num + den) - F.lit(1e-9))


def _neighbours(posts: DataFrame, num: int, den: int, orders: list[list]) -> DataFrame:
    """Candidate pairs along each list in each of the ``orders``; with a column comp, only those of different components.

    A list is cut into ``_BLOCKS`` parts by the row's hash, and the first rows of the parts make a
    list again, so that no task gets a whole list of a common n-gram.
    """
    named = "comp" in posts.columns
    row = F.struct("rep", "n", "at", *(["comp"] if named else []))
    dealt = posts.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(_BLOCKS)))
    found = []
    for order in orders:
        near, heads = Window.partitionBy("key", "block").orderBy(*order), Window.partitionBy("key").orderBy(*order)
        marked = dealt.withColumns({"before": F.lag(row).over(near), "k": F.row_number().over(near)})
        tops = marked.filter("k = 1").withColumn("before", F.lag(row).over(heads))
        found += [marked.filter("k > 1"), tops.filter("before IS NOT NULL")]
    met = reduce(DataFrame.unionByName, found)
    pairs = (met.filter("comp <> before.comp") if named else met).select(
        F.least("rep", "before.rep").alias("a"), F.greatest("rep", "before.rep").alias("b"),
        F.col("n").alias("na"), F.col("before.n").alias("nb"),
        (F.least(F.col("n") - F.col("at"), F.col("before.n") - F.col("before.at"))).alias("room"))
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    kept = pairs.filter((small * den >= large * num) & (F.col("room") >= _need(F.col("na"), F.col("nb"), num, den)))
    return kept.select("a", "b").distinct()


def _mixed(posts: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``posts`` with the row's component as comp, and (key, rows) of the lists that have rows of several components."""
    named = posts.join(comps, posts.rep == comps.node).drop("node").withColumnRenamed("component", "comp")
    lists = named.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    return named, lists.select("key", "rows")


def _across(num: int, den: int):
    def pairs(table: pa.Table) -> pa.Table:
        """Pairs of a list's rows in different components that pass all filters."""
        t = table.to_pandas()
        t = t.sort_values(["key", "i", "j", "n", "rep"], kind="stable")
        cells = np.frombuffer(b"".join(t["cells"]), dtype=np.uint8).reshape(-1, _CELLS)
        rep, size, at, comp, mine = (t[c].to_numpy() for c in ("rep", "n", "at", "comp", "block"))
        one = (t["i"] == t["j"]).to_numpy()
        group = t.groupby(["key", "i", "j"], sort=False).ngroup().to_numpy()
        ends = np.searchsorted(group, group, "right")
        found = []
        for x in range(len(t)):
            # Partners follow by size, up to the largest that the length filter admits.
            stop = x + 1 + np.searchsorted(size[x + 1: ends[x]], size[x] * den // num, "right")
            y = np.arange(x + 1, stop)
            y = y[(comp[y] != comp[x]) & (one[x] | (mine[y] != mine[x]))]
            if not len(y):
                continue
            need = -(-(size[x] + size[y]) * num // (num + den))
            y = y[np.minimum(size[x] - at[x], size[y] - at[y]) >= need]
            if not len(y):
                continue
            # Suffix filter: what two sets differ by at least, cell by cell.
            apart = cells[y] - cells[x]
            apart = np.minimum(apart, -apart).astype(np.int64).sum(1)
            need = -(-(size[x] + size[y]) * num // (num + den))
            y = y[apart <= size[x] + size[y] - 2 * need]
            found.append(np.stack([np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y])]))
        both = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1), axis=1)
        return pa.table({"a": pa.array(both[0], pa.int64()), "b": pa.array(both[1], pa.int64())})

    return pairs


def _crossing(posts: DataFrame, comps: DataFrame, sets: DataFrame, num: int, den: int, buckets: int) -> DataFrame:
    """All candidate pairs whose rows are in different components.

    Lists within one component have none. A longer list is dealt out as pairs of its blocks.
    """
    named, mixed = _mixed(posts, comps)
    blocks = F.ceil(F.col("rows") / _LIST_ROWS).cast("int")
    rows = named.join(mixed.select("key", blocks.alias("blocks")), "key")
    rows = rows.join(sets.select("rep", "cells"), "rep").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("*", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("key", "i", "j"), F.lit(buckets)))
    found = rows.select("_b", "key", "i", "j", "block", "rep", "n", "at", "comp", "cells").groupBy("_b").applyInArrow(_across(num, den), "a bigint, b bigint")
    return found.distinct()


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose whole sets are similar, with the size of their intersection."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, common = [], []
            for x, (p, q) in enumerate(zip(batch.column("ga"), batch.column("gb"), strict=True)):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                if both * den >= num * (len(p) + len(q) - both):
                    keep.append(x)
                    common.append(both)
            kept = batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(common, pa.int64())], ["a", "b", "common"])

    pairs = reliable(pairs.filter("a <> b"))
    used = light(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct())
    sets = sets.join(used, "rep", "left_semi")
    left, right = sets.select(F.col("rep").alias("a"), F.col("grams").alias("ga")), sets.select(F.col("rep").alias("b"), F.col("grams").alias("gb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ga", "gb").mapInArrow(check, "a bigint, b bigint, common bigint").distinct()


def _common(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many n-grams each of the sets numbered ``x`` shares with each of those numbered ``y``."""
    row, gram = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
    order = np.argsort(gram, kind="stable")
    row, gram = row[order], gram[order]
    held = np.diff(np.append(np.flatnonzero(np.append(True, gram[1:] != gram[:-1])), len(gram)))
    often = held > _OFTEN
    at_x, at_y = np.full(len(sets), -1), np.full(len(sets), -1)
    at_x[x], at_y[y] = np.arange(len(x)), np.arange(len(y))
    out = np.zeros((len(x), len(y)), np.int64)
    # An n-gram of few sets: each two of them.
    few = ~np.repeat(often, held)
    r, g = row[few], gram[few]
    for step in range(1, held[~often].max(initial=0)):
        same = np.flatnonzero(g[step:] == g[:-step])
        for p, q in ((r[same], r[same + step]), (r[same + step], r[same])):
            inside = (at_x[p] >= 0) & (at_y[q] >= 0)
            np.add.at(out.ravel(), at_x[p[inside]] * len(y) + at_y[q[inside]], 1)
    # N-grams of many sets: products of rows of zeros and ones.
    r, column = row[~few], np.repeat(np.arange(often.sum()), held[often])
    for start in range(0, int(often.sum()), 1024):
        lo, hi = np.searchsorted(column, [start, start + 1024])
        has = np.zeros((len(sets), 1024), np.float32)
        has[r[lo:hi], column[lo:hi] - start] = 1
        out += (has[x] @ has[y].T).astype(np.int64)
    return out


def _inside(num: int, den: int, pairs: bool):
    def compare(table: pa.Table) -> pa.Table:
        """Similar sets of each pair of blocks: the pairs, or how many each set has."""
        table = table.sort_by([(c, "ascending") for c in ("component", "i", "j")])
        of = [table.column(c).to_numpy() for c in ("component", "i", "j")]
        rep, size, mine = (table.column(c).to_numpy() for c in ("rep", "n", "block"))
        cuts = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in of], axis=0)))
        grams, degree, found = table.column("grams"), np.zeros(len(rep), np.int64), []
        for s, e in zip(cuts, np.append(cuts[1:], len(rep))):
            one = of[1][s] == of[2][s]
            x = np.arange(e - s) if one else np.flatnonzero(mine[s:e] == of[1][s])
            y = x if one else np.flatnonzero(mine[s:e] == of[2][s])
            both = _common([np.frombuffer(g.as_buffer(), np.uint64) for g in grams[int(s): int(e)]], x, y)
            x, y = x + s, y + s
            similar = both * den >= num * (size[x][:, None] + size[y] - both)
            if one:
                similar = np.triu(similar, 1)
            degree[x] += similar.sum(1)
            degree[y] += similar.sum(0)
            if pairs:
                p, q = np.nonzero(similar)
                found.append(np.stack([np.minimum(rep[x[p]], rep[y[q]]), np.maximum(rep[x[p]], rep[y[q]]), both[p, q]]))
        if pairs:
            return pa.table(dict(zip(("a", "b", "common"), np.concatenate([np.zeros((3, 0), np.int64), *found], axis=1), strict=True)))
        linked = pa.array(np.flatnonzero(degree))
        return table.select(["sig", "n"]).append_column("n_links", pa.array(degree)).take(linked)

    return compare


def _links(sets: DataFrame, comps: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(sig, n, n_links per pair of blocks) and (a, b, common), of all similar sets.

    Similar sets are in one component. Its sets are dealt out as pairs of blocks of bounded size, where each pair of
    sets meets once. Only the second table has a row per pair.
    """
    named = sets.join(comps, "rep")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / _SPAN_ROWS, F.sum("n") / _SPAN_GRAMS)).cast("int")
    sizes = light(named.groupBy("component").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total"), blocks.alias("blocks")).filter("rows > 1").drop("rows"))
    buckets = max(4 * partitions(sets.sparkSession), (sizes.agg(F.sum(F.col("total") * F.col("blocks"))).first()[0] or 0) // (2 * _SPAN_GRAMS))
    rows = named.join(sizes.drop("total"), "component").withColumn("block", F.pmod(F.xxhash64("rep", "sig"), F.col("blocks")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("component", "i", "j"), F.lit(buckets)))
    dealt = rows.select("_b", "component", "i", "j", "block", "rep", "sig", "n", "grams").groupBy("_b")
    return (dealt.applyInArrow(_inside(num, den, False), "sig binary, n bigint, n_links bigint"),
            dealt.applyInArrow(_inside(num, den, True), "a bigint, b bigint, common bigint"))


def _merged(base: DataFrame, edges: DataFrame) -> DataFrame:
    """``base`` (rep, component) with those components made one that ``edges`` connect."""
    ends = [base.select(F.col("rep").alias(c), F.col("component").alias(f"c{c}")) for c in "ab"]
    between = edges.join(ends[0], "a").join(ends[1], "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    tops = components(base.select(F.col("component").alias("node")).distinct(), between)
    return reliable(base.withColumnRenamed("component", "node").join(tops, "node").select("rep", "component"))


def jaccard_join(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(documents, links) of the similarity join of ``docs`` with itself.

    A document's set holds the distinct n-word sequences of its text, A-Z lower-cased, words being
    runs of anything but space and U+0009 to U+000D; the whole sequence where there are fewer words.
    Sets are similar when ``den * intersection >= num * union``. Documents: doc_id, n_shingles,
    class_id (smallest doc_id with the same set), component_id (smallest doc_id that links reach) and
    n_links (how many other classes its class is similar to). Links: a, b, common, one row per two similar classes,
    named by their class_ids. Components and links are exact. n_links is counted without a row per link; the links
    are worked out when they are asked for, and grow with the square of a dense group.

    Null and empty texts have an empty set and stay alone. Rows of one doc_id are one document if
    their texts are equal; else each has its row and links of its own, and they share a component through the doc_id
    (a link between two of them has a = b if the doc_id is the class_id of both). A null doc_id
    gives a row with null class and component and links nothing. An empty table gives empty tables;
    columns other than doc_id and text are ignored.
    """
    shaped = reliable(gram_sets(docs, n=n, num=num, den=den).withColumn("_row", F.monotonically_increasing_id()))
    known = shaped.filter("doc_id IS NOT NULL")
    # Materialised, so that the joins back to the rows deal out both sides and a hot class can be split.
    classes = reliable(known.filter("n > 0").groupBy("sig", "n").agg(F.min("doc_id").alias("rep")))
    # All members of a class have the same prefix or none; one row of the smallest one stands for it.
    with_prefix = known.filter("prefix IS NOT NULL")
    reps = light(with_prefix.groupBy("sig", "n").agg(F.min(F.struct("doc_id", "_row")).alias("r")).select("r._row"))
    sets = with_prefix.join(reps, "_row", "left_semi").select(F.col("doc_id").alias("rep"), "sig", "n", "prefix", "at", "cells", "grams")
    posts = sets.select("rep", "n", F.inline(F.arrays_zip(F.col("prefix").alias("key"), F.col("at").alias("at"))))

    by_size, by_place = ["n", "rep"], [F.col("at") / F.col("n"), "n", "rep"]
    first = reliable(_verified(_neighbours(posts, num, den, [by_size, by_place]), sets, num, den))
    nodes = sets.select(F.col("rep").alias("node")).distinct()
    joined = reliable(components(nodes, first))
    # Components that similar sets still hold apart meet once more in orders drawn by hash, so that few candidates are left across them.
    named, lists = _mixed(posts, joined)
    drawn = [[F.xxhash64("rep", F.lit(seed))] for seed in (1, 2)]
    again = _verified(_neighbours(named.join(lists.select("key"), "key"), num, den, drawn), sets, num, den)
    joined = _merged(joined.withColumnRenamed("node", "rep"), again.select("a", "b")).withColumnRenamed("rep", "node")
    buckets = max(1, posts.count() // 20_000)
    second = reliable(_verified(_crossing(posts, joined, sets, num, den, buckets), sets, num, den))

    base = reliable(
        classes.select(F.col("rep").alias("node")).distinct().join(joined, "node", "left")
        .select(F.col("node").alias("rep"), F.coalesce("component", "node").alias("component")))
    linked = _merged(base, second.select("a", "b"))
    counted, links = _links(sets.select("rep", "sig", "n", "grams"), linked, num, den)

    # Members that a doc_id holds together, beside the links between classes.
    member = known.filter("n > 0").join(classes, ["sig", "n"]).select("doc_id", "rep")
    twice = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("a", "b")
    comps = _merged(linked, twice)
    degree = counted.groupBy("sig", "n").agg(F.sum("n_links").alias("n_links"))
    named = classes.join(comps, "rep").join(degree, ["sig", "n"], "left")
    out = shaped.join(named.select("sig", "n", "rep", "component", "n_links"), ["sig", "n"], "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull() & F.col("n_links").isNotNull(), F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
    ), links
