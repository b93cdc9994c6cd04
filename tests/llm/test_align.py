"""Alignment of two tokenizers against all pairs of overlapping tokens."""

from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from conftest import SF_DIR
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quirework.llm import align

FILES = {"byte_level": public_tokenizers.path("byte_bpe_50k.json"), "pieces": public_tokenizers.path("piece_bpe_32k.model"), "pattern": public_tokenizers.PATTERN}
TEXTS = [
    None, "", " ", "  two  spaces ", "\n\n\n x", "<|endoftext|> </s><s> <0x41>", "naïve 東京タワー 😀👍🏽", "a" * 5000, "▁ marked ▁", "\x00\x01", "don't we'll", "ﬁne Å", "x y　z\x1c",
]


def plain(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """Every overlap by comparing byte ranges, every group by common ends."""
    a = Tokenizer.from_file(FILES["byte_level"])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES["pieces"])
    letters = {}
    for x in range(256):  # the letter of a byte, as the library itself spells it
        letters.setdefault(chr(x) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174 else chr(256 + len([y for y in range(x) if not (33 <= y <= 126 or 161 <= y <= 172 or y >= 174)])), x)
    seen = []
    for _, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            seen.append(([], [], [], []))
            continue
        spans = []
        for parts in (bytes_a, bytes_b):
            at, out = 0, []
            for p in parts:
                out.append((at, at + len(p)))
                at += len(p)
            spans.append(out)
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = []
        for lo, hi in zip([0, *ends], ends):
            inside = [",".join(str(i) for i, (s, e) in zip(ids, sp) if lo <= s and e <= hi) for ids, sp in ((ids_a, spans[0]), (ids_b, spans[1]))]
            groups.append("|".join(inside))
        links, first = [], 0
        for i, (s, e) in enumerate(spans[0]):
            while spans[1][first][1] <= s:
                first += 1
            j = first
            while j < len(spans[1]) and spans[1][j][0] < e:
                links.append((ids_a[i], ids_b[j]))
                j += 1
        seen.append((ids_a, ids_b, groups, links))
    counts = Counter(x for *_, links in seen for x in links)
    most: dict[int, int] = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for (doc, _), (ids_a, ids_b, groups, links) in zip(rows, seen, strict=True):
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc, len(ids_a), len(ids_b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return out


def _rows(df) -> list[tuple]:
    return sorted((tuple(r)[:8] for r in df.collect()), key=repr)


def test_whole_table_against_all_overlaps(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(TEXTS)] + [(None, "x y"), (None, "x y"), (5, "x y"), (5, "x y"), (None, None)], "doc_id bigint, text string")
    docs = docs.unionByName(odd)
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert _rows(align.align_tokens(docs, **FILES)) == sorted(want, key=repr)
    assert sum(r[1] == 0 for r in want) >= 3


def test_small_chunks_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i % 7, f"word {i % 5} again, naïve 東京 {'long ' * (i % 9)}") for i in range(300)], "doc_id bigint, text string")
    named = docs.withColumns({c: F.lit("x") for c in ("_chunk", "pairs", "n_a", "groups", "bucket", "keys")})
    want = sorted(plain([(r.doc_id, r.text) for r in docs.collect()]), key=repr)
    assert _rows(align.align_tokens(named, **FILES, chunk_bytes=100)) == want
    shown = align.align_tokens(named, **FILES, groups=True)
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in shown.collect())


def test_one_row_many_times(spark):
    docs = spark.range(20_000).select(F.lit(1).cast("bigint").alias("doc_id"), F.lit("one text").alias("text"))
    row = align.align_tokens(docs, **FILES).distinct().collect()
    assert len(row) == 1 and row[0].count_sum == row[0].n_links * 20_000 and row[0].n_best == row[0].n_links


def test_empty_table(spark):
    assert align.align_tokens(spark.createDataFrame([], "doc_id bigint, text string"), **FILES).count() == 0
