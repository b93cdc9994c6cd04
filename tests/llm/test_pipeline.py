"""The pipeline against a plain Python version of its stages, and each stage's promises."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from conftest import SF_DIR
from pyspark.sql import functions as F

import corpus_pipeline
from quirework.llm import bpe, quality
from quirework.llm.mixing import mix_sources, tempered

EDGE = " \t\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def cut(texts: dict[int, str]) -> dict[int, str]:
    lines = {i: t.split("\n") for i, t in texts.items()}
    solid = {i: [(k, x.strip(EDGE)) for k, x in enumerate(ls) if x.strip(EDGE)] for i, ls in lines.items()}
    first, gone = {}, {i: set() for i in texts}
    for i in sorted(texts):
        for at in range(len(solid[i]) - 2):
            key = tuple(x for _, x in solid[i][at: at + 3])
            if key not in first:
                first[key] = (i, at)
                continue
            own, start = first[key]
            low = max(at, start + 3) if own == i else at
            gone[i].update(range(solid[i][low][0], solid[i][at + 2][0] + 1))
    out = {i: "\n".join(x for k, x in enumerate(lines[i]) if k not in gone[i]) for i in texts}
    return {i: t for i, t in out.items() if not gone[i] or t.strip(EDGE + "\n")}


def apart(texts: dict[int, str]) -> dict[int, str]:
    sets = {}
    for i, t in texts.items():
        w = [x for x in t.translate(LOWER).replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
        sets[i] = {tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in texts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            p, q = sets[a], sets[b]
            if p and q and min(len(p), len(q)) * 10 >= 8 * max(len(p), len(q)) and 100 * len(p & q) >= 80 * len(p | q):
                lo, hi = sorted((top(a), top(b)))
                up[hi] = lo
    return {i: t for i, t in texts.items() if top(i) == i}


def test_run_equals_plain_version(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    network = quality.fit(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    rows = docs.collect()
    good = network.scores(pa.array([r.text for r in rows], pa.string())) >= 0.7
    left = apart(cut({r.doc_id: r.text for r, g in zip(rows, good) if g}))
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in left.items():
        ids = np.array(library.encode_ordinary(t), "<u4").tobytes()
        want[i] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    assert got == want and 0 < len(want) < len(rows)


def test_stages_keep_columns_and_take_edge_cases(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    text = "\n".join(f"Line {i} of a quiet story that goes on and on." for i in range(12))
    rows = [(None, text, None, None, None), (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, text, "en", "a", 5), (4, text, "en", "b", 5), (4, text, "en", "b", 5)]
    df = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF_DIR)
        assert out.schema.simpleString() == df.schema.simpleString(), name
        assert stage(spark, df.limit(0), SF_DIR).count() == 0, name
        out.collect()
    assert sorted(str(r.doc_id) for r in corpus_pipeline.drop_near_copies(spark, df, SF_DIR).collect()) == ["1", "2", "3", "None"]
    assert corpus_pipeline.mix(spark, df, SF_DIR).count() == len(rows)
    cut_rows = corpus_pipeline.cut_repeats(spark, df, SF_DIR).collect()
    assert sorted(str(r.doc_id) for r in cut_rows) == ["1", "2", "None"]
    assert corpus_pipeline.encode(spark, df.limit(0), SF_DIR).count() == 0


def mixed(spark, sources: dict[int, str]) -> list[int]:
    """The doc_ids in the order of the mixture, slot by slot."""
    frame = spark.createDataFrame([(i,) for i in sources], "doc_id bigint")
    turn = {r.doc_id: r.h for r in frame.select("doc_id", F.xxhash64(F.lit(42), "doc_id").alias("h")).collect()}
    waiting: dict[str, list[int]] = {}
    for i in sorted(sources, key=lambda i: (turn[i], i)):
        waiting.setdefault(sources[i], []).append(i)
    weights = tempered({s: len(w) for s, w in waiting.items()})
    out = []
    while waiting:
        names = sorted(waiting)
        shared = math.gcd(*[weights[s] for s in names])
        share, taken, slot = {s: weights[s] // shared for s in names}, dict.fromkeys(names, 0), 0
        total = sum(share.values())
        while all(waiting[s] for s in names):
            ready = [s for s in names if taken[s] * total // share[s] <= slot]
            s = min(ready, key=lambda s: (-(-(taken[s] + 1) * total // share[s]), -share[s], s))
            out += waiting[s][:16]
            waiting[s] = waiting[s][16:]
            taken[s], slot = taken[s] + 1, slot + 1
        waiting = {s: w for s, w in waiting.items() if w}
    return out


def test_position_is_the_order_of_the_mixture(spark):
    rows = [(i, f"text {i}", "en", "abc"[(i % 7 > 3) + (i % 7 > 5)], 6) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = mixed(spark, {r[0]: r[3] for r in rows})
    moved = corpus_pipeline.mix(spark, df, SF_DIR).repartition(5)
    got = corpus_pipeline.encode(spark, moved, SF_DIR).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.position)] == want
    assert sorted(r.position for r in got) == list(range(300))
    kept = {r.doc_id: r.position for r in corpus_pipeline.run(spark, SF_DIR).collect()}
    source = {r.doc_id: r.source or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "source").collect()}
    assert sorted(kept, key=kept.get) == mixed(spark, {i: source[i] for i in kept})


def test_encoding_follows_the_mixture(spark, tmp_path):
    """The weights are decided by the mixture: rows that go afterwards don't change them, and Parquet keeps them."""
    rows = [(i, f"text {i}", "en", "abc"[(i % 7 > 3) + (i % 7 > 5)], 6) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    corpus_pipeline.mix(spark, df, SF_DIR).write.parquet(str(tmp_path / "mixed"))
    left = spark.read.parquet(str(tmp_path / "mixed")).filter("source <> 'a' OR doc_id % 5 = 0")
    want = {r.doc_id: r._position for r in mix_sources(left, tempered({"a": 400, "b": 200, "c": 100})).collect()}
    assert {r.doc_id: r.position for r in corpus_pipeline.encode(spark, left, SF_DIR).collect()} == want
    assert want != {r.doc_id: r._position for r in mix_sources(left).collect()}


def test_near_copies_go_by_row(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(5, a), (5, b), (3, a), (7, "one two"), (7, "one two"), (7, "One  Two"), (8, b + " more"), (9, ""), (None, a), (None, a)]
    df = spark.createDataFrame([(i, t, "en", f"s{k}", 1) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    out = corpus_pipeline.drop_near_copies(spark, df, SF_DIR)
    assert out.schema.simpleString() == df.schema.simpleString()
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(x for x in got if x[0] != 7 and x[0] is not None) == [(3, a), (5, b), (9, "")]
    assert [t.lower().split() for i, t in got if i == 7] == [["one", "two"]]
    assert [x for x in got if x[0] is None] == [(None, a)] * 2


def test_columns_named_like_the_operators(spark):
    """Extra columns come through untouched, whatever their names."""
    text = "\n".join(f"Line {i} of a quiet story that goes on and on." for i in range(12))
    names = ("score", "row", "key", "nth", "rows", "n_lines", "n_removed", "removed", "_block", "_slot", "_position", "_release", "_deadline", "_row", "_text", "_n", "_score")
    rows = [(1, text, "en", "a", 1), (2, text + "\nmore", "en", "b", 2), (3, None, "en", "a", 0), (4, "Something else that stands alone here.", "en", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF_DIR)
        assert out.columns == df.columns, name
        assert all(r[c] == f"{c}{r.doc_id}" for r in out.collect() for c in names), name
    assert corpus_pipeline.encode(spark, df, SF_DIR).count() == len(rows)
