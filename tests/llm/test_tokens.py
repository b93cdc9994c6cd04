"""Byte-level BPE against the library, and the quality classifier on held-out rows."""

from __future__ import annotations

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from conftest import SF_DIR
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirework.llm import bpe, quality

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None, "", " ", "a" * 3000, "ab" * 2000, " " * 500, "\n\n\n x", "don't we'll  I'm", "naïve 東京タワー 😀👍🏽", "\x1c\x1d x\x85y　z", "12345 67.89", "!!!???", "\x00\x01", "é" * 400,
]


@pytest.fixture(scope="module")
def coder():
    return bpe.Encoder(bpe.Merges.of(bpe.read_ranks(PATH)))


@pytest.fixture(scope="module")
def library():
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_whole_table_equals_library(spark, library):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(TEXTS)] + [(None, "x y")] * 2, "doc_id bigint, text string"))
    rows = bpe.encode(docs, path=PATH, pattern=public_tokenizers.PATTERN).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(texts[r.doc_id])
        assert bytes(r.decoded).decode() == texts[r.doc_id]
        assert r.n_tokens * 4 == len(r.ids)
    assert bpe.encode(docs.limit(0), path=PATH, pattern=public_tokenizers.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdefgtheingrs \n'!1éß中😀\x1c"), max_size=60))
def test_pieces_equal_library(coder, library, text):
    got = coder.text(bpe.splitter(public_tokenizers.PATTERN).findall(text))
    assert np.frombuffer(got, "<u4").tolist() == library.encode_ordinary(text)


def test_tokens_no_merge_makes():
    # "abc" is listed but its parts never meet: only the whole piece is that token.
    tokens = [bytes([i]) for i in range(256)] + [b"ab", b"cd", b"bcd", b"abcd"]
    coder = bpe.Encoder(bpe.Merges.of(tokens))
    ranks = {t: i for i, t in enumerate(tokens)}
    for piece in (b"bcd", b"abcd", b"abcde", b"xbcd", b"bcdx", b"ababcdcd"):
        want = [ranks[piece]] if piece in ranks else [ranks[p] for p in bpe.merged(piece, ranks, len(tokens))]
        assert coder.ids(piece) == want


# ---- quality ---------------------------------------------------------------------------------------
def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    network = quality.fit(docs, labels)
    scored = quality.score(docs, network).join(labels, "doc_id").filter("crc32(cast(doc_id as string)) % 4 = 2").select("score", "quality").collect()
    assert len(scored) > 50
    assert sum((r.score >= 0.7) == (r.quality == 1) for r in scored) / len(scored) >= 0.95


def test_quality_edges(spark):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(None, 1, 0), (3, None, 0), (4, 0, 0)], "doc_id bigint, quality int, toxic int")
    rows = [(i, ("good words here " if i % 2 else "BAD!! BAD!! ") * 20, "x") for i in range(60)] + [(61, None, "x"), (62, "", "x"), (None, "good words here", "x"), (63, "z" * 200_000, "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    network = quality.fit(docs, labels)
    got = quality.score(docs, network)
    assert got.columns == ["doc_id", "text", "score"] and got.count() == len(rows)
    by = {}
    for r in got.collect():
        assert 0 <= r.score <= 1
        by.setdefault(r.text, set()).add(r.score)
    assert all(len(s) == 1 for s in by.values()) and by[None] == by[""]
    assert quality.score(docs.limit(0), network).count() == 0
    flat = quality.fit(docs.limit(0), labels)
    assert flat.scores(pa.array(["a", "b"])).tolist() == [0.5, 0.5]
    ones = quality.train(pa.array(["a b"] * 20), np.ones(20))
    assert 0.9 < ones.scores(pa.array(["q"]))[0] < 1


def test_a_long_text_does_not_end_the_sample(spark):
    ids = [r.doc_id for r in spark.range(200).withColumnRenamed("id", "doc_id").filter(quality.crc_fold(F.col("doc_id")) != 2)
           .orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    rows = [(i, "long " * 2000 if k == 0 else ("fine words here" if i % 2 else "bad ### junk")) for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id bigint, quality int")
    network = quality.fit(docs, labels, fit_bytes=5000)
    good, bad = network.scores(pa.array(["fine words here", "bad ### junk"]))
    assert good > 0.7 > 0.3 > bad
    with pytest.raises(ValueError, match="too few"):
        quality.fit(docs, labels, fit_bytes=40)


def _plain_vectors(texts: list[str]) -> dict[str, np.ndarray]:
    """Word vectors word by word: summed index vectors of the words at most two places away, made unit length."""
    places, signs = quality.index_vectors(quality._SLOTS, 1)
    slot = {w: int(next(iter(quality.read_words(pa.array([w])))).slot[0]) for t in texts for w in t.split()}
    sums: dict[int, np.ndarray] = {}
    for words in (t.split() for t in texts):
        for i, w in enumerate(words):
            for j in range(max(0, i - 2), min(len(words), i + 3)):
                if j != i:
                    v = sums.setdefault(slot[w], np.zeros(quality._DIM))
                    for p, s in zip(places[slot[words[j]]], signs[slot[words[j]]]):
                        v[p] += s
    return {w: sums[k] / np.linalg.norm(sums[k]) for w, k in slot.items() if k in sums and np.linalg.norm(sums[k]) > 0}


def test_word_vectors_and_pooling_by_hand(spark):
    texts = [f"word{i % 7} other{i % 3} third{i % 5} Last{i % 2}, end" for i in range(60)] + ["alone", "", "a a a b"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id bigint, text string").repartition(5)
    vectors = quality.corpus_vectors(docs)
    plain = _plain_vectors(texts)
    for w, v in plain.items():
        slot = int(next(iter(quality.read_words(pa.array([w])))).slot[0])
        assert np.allclose(vectors[slot], v, atol=1e-6)
    one = next(iter(quality.read_words(pa.array([texts[0]]))))
    pooled = quality.pooled(one, vectors)[0]
    assert np.allclose(pooled[: quality._DIM], np.mean([plain[w] for w in texts[0].split()], axis=0), atol=1e-5)
    assert np.isclose(pooled[-3], np.log1p(5) / 10) and pooled[-2] == 0 and pooled[-1] == 0


def test_fit_equals_learning_from_all_texts_at_hand(spark):
    """Where every text is labelled and learned from, fit on Spark is learn on one machine."""
    ids = [i for i in range(400)]
    frame = spark.createDataFrame([(i,) for i in ids], "doc_id bigint")
    ids = sorted(r.doc_id for r in frame.filter(quality.crc_fold(F.col("doc_id")) != 2).collect())
    texts = {i: (f"fine words here number {i} and more" if i % 2 else f"bad ### junk!! {i} $$") for i in ids}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id bigint, quality int")
    order = np.random.default_rng(3).permutation(len(ids))
    want = quality.train(pa.array([texts[ids[k]] for k in order]), np.array([ids[k] % 2 for k in order]))
    got = quality.fit(docs, labels)
    some = pa.array([texts[i] for i in ids[:50]] + ["", "unseen words"])
    assert got.temperature == want.temperature and np.allclose(got.scores(some), want.scores(some), atol=1e-4)


def test_a_labelled_row_many_times_weighs_nothing(spark):
    ids = [r.doc_id for r in spark.range(300).withColumnRenamed("id", "doc_id").filter(quality.crc_fold(F.col("doc_id")) != 2).collect()]
    rows = [(i, "fine words here" if i % 2 else "bad ### junk") for i in ids]
    hot = spark.range(20_000).select(F.lit(ids[1]).cast("bigint").alias("doc_id"), F.lit(rows[1][1]).alias("text"))
    docs = hot.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"))
    network = quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in ids], "doc_id bigint, quality int"))
    good, bad = network.scores(pa.array(["fine words here", "bad ### junk"]))
    assert good > 0.7 > 0.3 > bad


def test_memory_of_reading_and_pooling_is_bounded():
    """A megabyte of short texts takes some megabytes at once, not the vectors of all its words; texts pool alike alone and together."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 5000, int(size))) for size in rng.integers(0, 700, 600)] + ["", "x " * 40_000, ""]
    vectors = quality._dense(quality._SLOTS, 1)
    alone = np.concatenate([quality.pooled(w, vectors) for t in texts[::40] + texts[-3:] for w in quality.read_words(pa.array([t]))])
    array = pa.array(texts)
    tracemalloc.start()
    together = np.concatenate([quality.pooled(w, vectors) for w in quality.read_words(array)])
    pooling = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    sums = quality.context_sums(quality.read_words(array))
    summing = tracemalloc.get_traced_memory()[1] - before - sums.nbytes
    tracemalloc.stop()
    assert np.array_equal(alone, np.concatenate([together[::40][: len(texts[::40])], together[-3:]]))
    assert pooling < 60 << 20 and summing < 40 << 20, (pooling >> 20, summing >> 20)
