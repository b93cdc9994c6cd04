"""Alignment of two tokenizers' tokens over the same bytes (operator 11).

Each sequence's cumulative byte ends become a dictionary from end to index. The ends that both share,
found by intersecting the two key sets, are sorted and cut both id lists into groups; inside a group
every two tokens whose byte ranges overlap are linked. Links are then counted per pair of ids over the
whole corpus: chunks of documents send each of their pairs once to buckets of the pairs, which sum
them and answer every chunk in the order it asked.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quirework.llm.keycount import pack, unpack
from quirework.llm.shared import partitions, reliable
from quirework.llm.words import mix

#: Groups that a worker remembers, and the most ids of one.
_KEEP, _LONG = 200_000, 64
#: Pairs that a bucket is meant to sum.
_BUCKET_PAIRS = 1 << 21


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabularies: a byte that is printable in
    Latin-1 is its own letter, the others take the letters from U+0100 on in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


def as_ranks(byte_level: dict) -> dict[bytes, int] | None:
    """Bytes to ids where ids rise with the merges, so that the lowest id is the first merge; None for other vocabularies."""
    letters, model = byte_letters(), byte_level["model"]
    own = {t["content"] for t in byte_level["added_tokens"]}
    vocab = {t: i for t, i in model["vocab"].items() if t not in own}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab.get(x + y, -1) for x, y in merges]
    rising = all(i < j for i, j in zip(made, made[1:])) and set(made) | {vocab.get(c) for c in letters} == set(vocab.values())
    if not rising or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    return {bytes(letters[c] for c in t): i for t, i in vocab.items()}


class _Ones(dict):
    """Text of the group of one A and one B id, by pair key."""

    def __init__(self, n: int) -> None:
        self.n = n
        self[-1] = ""

    def __missing__(self, key: int) -> str:
        text = "%d|%d" % divmod(key, self.n)
        if len(self) < _KEEP:
            self[key] = text
        return text


class Pair:
    """Both tokenizers, as made in a worker from their files' contents.

    Where the byte-level file's ids are ranks of its merges, a text is encoded by these ranks and ``pattern``, which is
    what its own cutting does and several times faster; else by the tokenizer itself.
    """

    def __init__(self, byte_level: str, pieces: bytes, pattern: str) -> None:
        self.whole = Tokenizer.from_str(byte_level)
        self.whole.encode_special_tokens = True
        ranks = as_ranks(json.loads(byte_level))
        self.lossless = bool(ranks) and all(bytes([x]) in ranks for x in range(256))
        self.ranked = ranks and tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        letters, vocab = byte_letters(), self.whole.get_vocab(True)
        self.bytes_a = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            known = all(c in letters for c in token)
            self.bytes_a[i] = bytes(letters[c] for c in token) if known else token.encode()
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        self.ones = _Ones(len(self.bytes_b))
        self.groups: dict[tuple, tuple[str, list[int]]] = {}

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[1:-1], 16)])
        if self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i):
            return b""
        return self.b.id_to_piece(i).replace("▁", " ").encode()

    def ids_a(self, text: str) -> np.ndarray:
        ids = self.ranked.encode_to_numpy(text) if self.ranked else self.whole.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype=np.int64)

    def linked(self, a: list[int], b: list[int]) -> list[int]:
        """Pair keys of the tokens of one group whose byte ranges overlap."""
        out, n, i, j, end_a, end_b = [], len(self.bytes_b), 0, 0, 0, 0
        while i < len(a) and j < len(b):
            x, y = len(self.bytes_a[a[i]]), len(self.bytes_b[b[j]])
            if x and y and max(end_a, end_b) < min(end_a + x, end_b + y):
                out.append(a[i] * n + b[j])
            if end_a + x <= end_b + y:
                i, end_a = i + 1, end_a + x
            else:
                j, end_b = j + 1, end_b + y
        return out

    def group(self, a: list[int], b: list[int]) -> tuple[str, list[int]]:
        key = (*a, -1, *b)
        found = self.groups.get(key)
        if found is None:
            found = f"{','.join(map(str, a))}|{','.join(map(str, b))}", self.linked(a, b)
            if len(key) <= _LONG:
                if len(self.groups) >= _KEEP:
                    self.groups.clear()
                self.groups[key] = found
        return found

    def align(self, a: np.ndarray, b: list[int]) -> tuple[list[str], np.ndarray]:
        """The groups as text and the pair keys of all links."""
        ids_b = np.array(b, dtype=np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[ids_b])
        # From end to index as arrays with a place for every byte; of tokens with one end the last counts, 0 is no token's end.
        at_a, at_b = np.zeros((2, max([0, *ends_a[-1:], *ends_b[-1:]]) + 1), dtype=np.int32)
        at_a[ends_a], at_b[ends_b] = np.arange(1, len(a) + 1), np.arange(1, len(b) + 1)
        shared = np.flatnonzero((at_a > 0) & (at_b > 0))
        cuts_a, cuts_b = (np.concatenate([[0], at[shared]]) for at in (at_a, at_b))
        # Groups of one token each are most of them: their one link is their pair.
        one = (np.diff(cuts_a) == 1) & (np.diff(cuts_b) == 1)
        pairs = np.where(one, a[cuts_a[:-1]] * len(self.bytes_b) + ids_b[cuts_b[:-1]], -1) if len(shared) else np.zeros(0, np.int64)
        texts = list(map(self.ones.__getitem__, pairs.tolist()))
        links: list[int] = []
        more = np.flatnonzero(~one)
        if len(more):
            all_a, known = a.tolist(), self.groups.get
            for g, i, j, k, m in zip(more.tolist(), *(x.tolist() for x in (cuts_a[more], cuts_a[more + 1], cuts_b[more], cuts_b[more + 1]))):
                texts[g], found = known((*all_a[i:j], -1, *b[k:m])) or self.group(all_a[i:j], b[k:m])
                links += found
        return texts, np.concatenate([pairs[one], np.array(links, dtype=np.int64)])

    def both(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[int]]]:
        """Ids of space+text by the first and of the text by the second; none where the bytes differ."""
        seen, none = [t or "" for t in texts], np.zeros(0, np.int64)
        for text, b in zip(seen, self.b.encode(seen, num_threads=1), strict=True):
            if not text:
                yield none, []
                continue
            whole = " " + text
            a, want = self.ids_a(whole), whole.encode()
            same = b"".join(map(self.bytes_b.__getitem__, b)) == want
            # Ranks that hold all single bytes give every text back.
            if same and not self.lossless:
                same = b"".join(map(self.bytes_a.__getitem__, a.tolist())) == want
            yield (a, b) if same else (none, [])


class Files:
    """What is broadcast: two vocabulary files. A worker keeps the tokenizers that it made of them between its tasks."""

    def __init__(self, byte_level: str, pieces: bytes, pattern: str) -> None:
        self.given = byte_level, pieces, pattern
        self.made: Pair | None = None

    def pair(self) -> Pair:
        if self.made is None:
            self.made = Pair(*self.given)
        return self.made


_ALIGNED = "_chunk bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, groups_sha256 string, pairs binary, times binary"


def _aligner(files, chunk_bytes: int, texts_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, first = files.value.pair(), TaskContext.get().partitionId() << 32
        chunk, held = 0, 0
        for batch in batches:
            for start in range(0, len(batch), 8):
                rows = batch.slice(start, 8)
                texts, out = rows.column("text").to_pylist(), []
                for doc, text, (a, b) in zip(rows.column("doc_id").to_pylist(), texts, pair.both(texts), strict=True):
                    if held >= chunk_bytes:
                        chunk, held = chunk + 1, 0
                    groups, links = pair.align(a, b)
                    pairs, times = np.unique(links, return_counts=True)
                    held += len(text or "") + 1
                    shown = ";".join(groups)
                    out.append((
                        first + chunk, doc, len(a), len(b), len(groups), len(links), shown if texts_too else None,
                        hashlib.sha256(shown.encode()).hexdigest() if groups else "", pairs.tobytes(), pack(times)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in out], t) for k, t in enumerate(
                        [pa.int64()] * 6 + [pa.string(), pa.string(), pa.binary(), pa.binary()])],
                    [c.split()[0] for c in _ALIGNED.split(", ")])

    return run


def _read(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of a chunk's rows, how often each row has them, and the rows' borders."""
    raw = table.column("pairs").to_pylist()
    sizes = [len(p) // 8 for p in raw]
    times = [unpack(t, n) for t, n in zip(table.column("times").to_pylist(), sizes, strict=True)]
    return np.frombuffer(b"".join(raw), dtype=np.int64), np.concatenate([np.zeros(0, np.uint64), *times]), np.cumsum([0, *sizes])


def _asked(pairs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's distinct pairs by bucket, and where each bucket begins."""
    keys = np.unique(pairs)
    bucket = (mix(keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return keys[order], np.searchsorted(bucket[order], np.arange(buckets + 1))


def _counting(buckets: int, size_b: int):
    def ask(table: pa.Table) -> pa.Table:
        chunk = table.column("_chunk")[0].as_py()
        pairs, times, _ = _read(table)
        keys, edges = _asked(pairs, buckets)
        found, where = np.unique(pairs, return_inverse=True)
        sums = np.bincount(where, weights=times.astype(np.float64), minlength=len(found)).astype(np.uint64)
        weights = sums[np.searchsorted(found, keys)]
        used = np.flatnonzero(np.diff(edges))
        return pa.table({
            "_chunk": pa.array([chunk] * len(used), pa.int64()), "bucket": pa.array(used, pa.int32()),
            "keys": pa.array([keys[edges[k]:edges[k + 1]].tobytes() for k in used], pa.binary()),
            "n": pa.array([pack(weights[edges[k]:edges[k + 1]]) for k in used], pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        raw = table.column("keys").to_pylist()
        sizes = [len(r) // 8 for r in raw]
        found, where = np.unique(np.frombuffer(b"".join(raw), dtype=np.int64), return_inverse=True)
        weights = np.concatenate([unpack(w, k) for w, k in zip(table.column("n").to_pylist(), sizes, strict=True)])
        sums = np.bincount(where, weights=weights.astype(np.float64), minlength=len(found)).astype(np.int64)
        cuts = np.cumsum([0, *sizes])
        # One more row: the most frequent pair of each second id in this bucket.
        ids, at = np.unique(found % size_b, return_inverse=True)
        most = np.zeros(len(ids), dtype=np.int64)
        np.maximum.at(most, at, sums)
        told = [pack(sums[where[s:e]]) for s, e in zip(cuts, cuts[1:])]
        return pa.table({
            "_chunk": pa.array([*table.column("_chunk").to_pylist(), None], pa.int64()),
            "bucket": pa.array([*table.column("bucket").to_pylist(), table.column("bucket")[0].as_py()], pa.int32()),
            "keys": pa.array([None] * len(told) + [ids.tobytes()], pa.binary()), "n": pa.array([*told, most.tobytes()], pa.binary())})

    return ask, total


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, most in zip(batch.column("keys").to_pylist(), batch.column("n").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, dtype=np.int64)) for x in (ids, most)], ["id", "most"])


def _telling(best, buckets: int, size_b: int, fields: list[str]):
    def tell(rows: pa.Table, answers: pa.Table) -> pa.Table:
        pairs, times, cuts = _read(rows)
        keys, edges = _asked(pairs, buckets)
        counts = np.zeros(len(keys), dtype=np.int64)
        for k, n in zip(answers.column("bucket").to_pylist(), answers.column("n").to_pylist(), strict=True):
            counts[edges[k]:edges[k + 1]] = unpack(n, edges[k + 1] - edges[k])
        order = np.argsort(keys)
        count = counts[order][np.searchsorted(keys[order], pairs)]
        times = times.astype(np.int64)
        top = times * (count == best.value[pairs % size_b])
        # By exact integer prefix sums.
        per_row = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[cuts])
        return pa.table({**{c: rows.column(c) for c in fields}, "n_best": pa.array(per_row(top), pa.int64()), "count_sum": pa.array(per_row(times * count), pa.int64())})

    return tell


def align_tokens(docs: DataFrame, *, byte_level: str, pieces: str, pattern: str, chunk_bytes: int = 8 << 20, groups: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and the groups themselves if asked for.

    ``byte_level`` is the file of a byte-level BPE tokenizer (A; encodes space+text), cut by ``pattern``; ``pieces`` a
    piece model that adds the space itself (B). Special tokens in a text are plain text. A group's text is
    ``a1,a2|b1``; groups are joined by ``;``. An id pair's count is the number of links of the corpus that hold it,
    repeated rows included; n_best counts a row's links whose pair is the most frequent one of its B id, count_sum adds up all counts.

    A text that is null, empty, or that either tokenizer does not give back byte by byte has no tokens: zeros and an empty string. A null doc_id
    stays null; other columns are ignored; an empty table gives an empty result. Texts of any length take linear time.

    Chunks hold ``chunk_bytes`` of text, or one text if that is longer, and are numbered where rows lie, so rows of
    one doc_id share nothing. Per B id one number goes to every task: at most the entries of its vocabulary.
    """
    spark = docs.sparkSession
    with open(byte_level, encoding="utf-8") as a, open(pieces, "rb") as b:
        given = Files(json.dumps(json.load(a)), b.read(), pattern)
    size_b = sentencepiece.SentencePieceProcessor(model_proto=given.given[1]).get_piece_size()
    files = spark.sparkContext.broadcast(given)
    aligned = reliable(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_aligner(files, chunk_bytes, groups), _ALIGNED))
    held = aligned.agg(F.sum(F.octet_length("pairs"))).first()[0] or 0
    buckets = max(2 * partitions(spark), held // 8 // _BUCKET_PAIRS)
    ask, total = _counting(buckets, size_b)
    asked = aligned.select("_chunk", "pairs", "times").groupBy("_chunk").applyInArrow(ask, "_chunk bigint, bucket int, keys binary, n binary")
    answers = reliable(asked.groupBy("bucket").applyInArrow(total, "_chunk bigint, bucket int, keys binary, n binary"))
    most = answers.filter("_chunk IS NULL").select("keys", "n").mapInArrow(_tops, "id bigint, most bigint").groupBy("id").agg(F.max("most").alias("most"))
    best = np.zeros(size_b, dtype=np.int64)
    for row in most.toLocalIterator():
        best[row["id"]] = row["most"]
    fields = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if groups else [])]
    tell = _telling(spark.sparkContext.broadcast(best), buckets, size_b, fields)
    out = aligned.groupBy("_chunk").cogroup(answers.filter("_chunk IS NOT NULL").select("_chunk", "bucket", "n").groupBy("_chunk")).applyInArrow(
        tell, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
        + (", groups string" if groups else "") + ", n_best bigint, count_sum bigint")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", *fields[5:])
