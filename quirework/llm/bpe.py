"""Byte-level BPE encoding and decoding by backtracking over longest matches (operator 7).

A sequence of tokens is what the merges yield exactly when every two neighbours are compatible: when
the merges, run over the two tokens' bytes, would not join across their border. The encoder takes
the longest token at each place from an Aho-Corasick automaton over the bytes as Latin-1, goes on
while the last two are compatible, else to the next shorter token, else one token back. A
place found to be a dead end is never tried again, so the time is linear in the bytes.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces and pairs that a worker remembers.
_KEEP = 500_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order from lines of base64 and rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranks = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


def merged(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """The merges by their definition, with ranks under ``below``: join the lowest-ranked pair, leftmost first."""
    parts = [piece[i: i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if best >= below:
            break
        parts[at: at + 2] = [parts[at] + parts[at + 1]]
    return parts


@dataclass(frozen=True)
class Merges:
    """Tokens by rank and the two that each was merged from (-1: a single byte; -2: never made by merges)."""

    tokens: list[bytes]
    left: np.ndarray
    right: np.ndarray

    @staticmethod
    def of(tokens: list[bytes]) -> Merges:
        ranks = {t: i for i, t in enumerate(tokens)}
        left, right = np.full(len(tokens), -1, np.int32), np.full(len(tokens), -1, np.int32)
        for i, t in enumerate(tokens):
            if len(t) > 1:
                parts = merged(t, ranks, i)
                left[i], right[i] = (ranks.get(parts[0], -2), ranks.get(parts[1], -2)) if len(parts) == 2 else (-2, -2)
        return Merges(tokens, left, right)


class Encoder:
    """Encodes pieces of text; lives in a worker. ``pieces`` remembers those met, up to a bound."""

    def __init__(self, merges: Merges) -> None:
        self.tokens = merges.tokens
        self.left, self.right = merges.left.tolist(), merges.right.tolist()
        self.whole = {t: i for i, t in enumerate(merges.tokens)}
        made = {t: i for t, i in self.whole.items() if self.left[i] != -2}
        self.joined = {(self.left[i], self.right[i]): i for i in made.values() if self.left[i] >= 0}
        self.shorter = [-1] * len(self.tokens)
        self.sizes = [len(t) for t in self.tokens]
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, i in made.items():
            self.trie.add_word(t.decode("latin-1"), i)
            self.shorter[i] = next((made[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in made), -1)
        self.trie.make_automaton()
        #: By a * number of tokens + b: an integer takes less than half the memory of a pair.
        self.fits: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave the border between tokens a and b alone.

        Undo the merges of both, latest first: at each moment the two parts at the border must not
        have been joined before the merges undone so far.
        """
        left, right, joined = self.left, self.right, self.joined
        x, y, horizon, answer = a, b, len(self.tokens), True
        while True:
            if joined.get((x, y), horizon) < horizon:
                answer = False
                break
            # Of two merges, the later one is undone first; of equal ones, the right.
            if x > y and left[x] >= 0 or left[y] < 0 <= left[x]:
                horizon, x = x, right[x]
            elif left[y] >= 0:
                horizon, y = y + 1, left[y]
            else:
                break
        if len(self.fits) >= _KEEP:
            self.fits.clear()
        self.fits[a * len(self.tokens) + b] = answer
        return answer

    def ids(self, piece: bytes) -> list[int]:
        """The ids of one piece, as the merges give them; a piece that is a token is that token."""
        if (one := self.whole.get(piece)) is not None:
            return [one]
        end = len(piece)
        longest, sizes, shorter, fits, n = [0] * end, self.sizes, self.shorter, self.fits, len(self.tokens)
        for last, token in self.trie.iter(piece.decode("latin-1")):
            longest[last - sizes[token] + 1] = token
        dead: set[int] = set()
        out: list[int] = []
        at, token, before = 0, longest[0], -1
        while True:
            stop = at + sizes[token]
            if stop not in dead:
                if before < 0 or (fit := fits.get(before * n + token)) or fit is None and self.compatible(before, token):
                    out.append(token)
                    if stop == end:
                        return out
                    at, before, token = stop, token, longest[stop]
                    continue
            if shorter[token] >= 0:
                token = shorter[token]
            else:
                dead.add(at)
                token = out.pop()
                at -= sizes[token]
                before = out[-1] if out else -1

    def packed(self, piece: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        found = array("I", self.ids(piece.encode())).tobytes()
        if len(self.pieces) >= _KEEP:
            self.pieces.clear()
        self.pieces[piece] = found
        return found

    def text(self, pieces: list[str]) -> bytes:
        known = self.pieces
        return b"".join([known.get(p) or self.packed(p) for p in pieces])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def splitter(pattern: str) -> regex.Pattern:
    """The pattern with white space as Unicode's property, whatever the library's own class is."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class Vocabulary:
    """What is broadcast: a bounded table. A worker keeps the encoder that it made of it between its tasks."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.made: Encoder | None = None

    def encoder(self) -> Encoder:
        if self.made is None:
            self.made = Encoder(self.merges)
        return self.made


def encode(docs: DataFrame, *, path: str, pattern: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids (little-endian 32-bit), decoded (bytes of the ids), and the bigint columns ``carry``.

    ``path`` is a file of ranks, read once by the driver; ``pattern`` cuts the text into pieces that are
    encoded separately, without special tokens. A null text counts as empty: no ids. A null doc_id
    stays null, repeated rows are encoded each, other columns are ignored, an empty table gives an
    empty one. One pass, no shuffle; texts of any length take linear time and are held one batch at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(Merges.of(read_ranks(path))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, pieces = shared.value.encoder(), splitter(pattern)
        for batch in batches:
            for start in range(0, len(batch), 256):
                rows = batch.slice(start, 256)
                ids = [coder.text(pieces.findall(t or "")) for t in rows.column("text").to_pylist()]
                back = [coder.decode(np.frombuffer(i, dtype="<u4")) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()),
                     pa.array(ids, pa.binary()), pa.array(back, pa.binary()), *[rows.column(c) for c in carry]],
                    ["doc_id", "n_tokens", "ids", "decoded", *carry])

    shape = ", ".join(["doc_id bigint, n_tokens bigint, ids binary, decoded binary", *[f"{c} bigint" for c in carry]])
    return docs.select("doc_id", "text", *carry).mapInArrow(run, shape)



def digests(encoded: DataFrame) -> DataFrame:
    more = [c for c in encoded.columns if c not in ("doc_id", "n_tokens", "ids", "decoded")]
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *more)
