"""Cross-entropy difference of two n-gram models (operator 1).

A target and a background model of the same order and smoothing, over one vocabulary, are counted on
the whole corpus. A document's score is the mean over its tokens of the target model's loss
less the background model's: the lower, the more the document is like the target.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.keycount import KeyCount
from quirework.llm.words import mix, word_spans

_EDGE = np.uint64(0x1F83D9ABFB41BD6B)  # stands before the first word and after the last
_TOTAL = np.uint64(0x5BE0CD19137E2179)


def _single(words: np.ndarray) -> np.ndarray:
    return mix(words ^ np.uint64(0x3C6EF372FE94F82B))


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first) * np.uint64(0xD6E8FEB86659FD93) + second)


def _read(table: pa.Table):
    """Of a chunk: doc_ids, numbers of words, target marks, and per token its document and its keys.

    The tokens of a document are its words and the edge after them; one without words has none.
    """
    rows = table.filter(pc.is_valid(table.column("text")))
    ids = rows.column("doc_id").to_pylist()
    marked = set(table.filter(pc.is_null(table.column("text"))).column("doc_id").to_pylist())
    before, after, sizes = [], [], []
    for _, hashes, _, _, cuts in word_spans(rows.column("text")):
        for s, e in zip(cuts, cuts[1:]):
            sizes.append(e - s)
            if e > s:
                before += [[_EDGE], hashes[s:e]]
                after += [hashes[s:e], [_EDGE]]
    none = np.zeros(0, np.uint64)
    v, w = np.concatenate([none, *before]).astype(np.uint64), np.concatenate([none, *after]).astype(np.uint64)
    sizes = np.array(sizes, dtype=np.int64)
    doc = np.repeat(np.arange(len(ids)), sizes + (sizes > 0))
    target = np.array([i in marked for i in ids], dtype=bool)
    return ids, sizes, target, doc, _single(v), _single(w), _pair(v, w)


def _extract(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    _, _, target, doc, _, single, pair = _read(table)
    keys, where = np.unique(np.concatenate([single, pair, np.full(len(pair), _TOTAL)]), return_inverse=True)
    mark = np.tile(target[doc].astype(np.float64), 3)
    inside = np.bincount(where, weights=mark, minlength=len(keys))
    every = np.bincount(where, minlength=len(keys))
    return keys, [inside, every - inside]


def _score(pair_weight: float, single_weight: float):
    def use(table: pa.Table, keys: np.ndarray, counts: list[np.ndarray]) -> pa.Table:
        ids, sizes, _, doc, context, single, pair = _read(table)
        if len(keys):
            at = lambda k: np.searchsorted(keys, k)
            c, u, b, n = at(context), at(single), at(pair), at(_TOTAL)
            both = counts[0] + counts[1]
            shared = both[u] / both[n]
            loss = []
            for count in counts:
                alone = (count[u] + single_weight * shared) / (count[n] + single_weight)
                loss.append(-np.log((count[b] + pair_weight * alone) / (count[c] + pair_weight)))
            tokens = np.maximum(sizes + (sizes > 0), 1)
            mean = np.bincount(doc, weights=loss[0] - loss[1], minlength=len(ids)) / tokens
        else:
            mean = np.zeros(len(ids))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(sizes, pa.int64()), "difference": pa.array(mean, mask=sizes == 0)})

    return use


def entropy_difference(docs: DataFrame, target: DataFrame, *, pair_weight: float = 4.0, single_weight: float = 100.0) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, difference (target loss less background loss per token, in nats).

    ``target`` names the documents of the target by doc_id; all others are the background. Words are runs of
    anything but space and U+0009 to U+000D, A-Z lower-cased; their vocabulary is the corpus's own and
    shared. Both models are bigram models; a bigram's share is smoothed with ``pair_weight``
    times the model's unigram share, and that with ``single_weight`` times the corpus's.

    A null or empty text has 0 words, a null difference and no part in any count. A null doc_id is never
    target. Repeated rows count and score as often as they stand; repeated marks count once; other columns
    are ignored; an empty table gives an empty one. Counts are kept on the workers, for bigrams of any
    frequency, and grow with the corpus; nothing is sent to the driver but the number of bytes.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    marks = target.select("doc_id", F.lit(None).cast("string").alias("text")).filter("doc_id IS NOT NULL").distinct()
    count = KeyCount.sized(rows, _extract, 2, keys_per_byte=1 / 8)
    chunked = count.chunked(rows.unionByName(marks), F.col("doc_id"))
    schema = "doc_id bigint, n_words bigint, difference double"
    return count.tell(chunked, count.answers(chunked), _score(pair_weight, single_weight), schema)
