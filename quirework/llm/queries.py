"""The registered queries of this package, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from quirework.llm import bpe, quality
from quirework.llm.align import align_tokens
from quirework.llm.ann import nearest
from quirework.llm.exact_dedup import content_sort
from quirework.llm.line_dedup import remove_repeated_windows
from quirework.llm.lm_score import entropy_difference
from quirework.llm.mixing import mix_sources
from quirework.llm.ngram_join import jaccard_join
from quirework.llm.pii import KINDS, find_personal_data
from quirework.llm.search import ranked_search
from quirework.llm.topk import nearest_products
from quirework.llm.warc import resolve_revisits
from quirework.plans.registry import Build, Query

QUERIES: dict[str, Query] = {}


def _add(covers: str, sql: str | None = None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        QUERIES[build.__name__] = Query(build.__name__, build, sql, covers)
        return build

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex256(data: Column) -> Column:
    return F.sha2(data, 256)


# ---- 1 -------------------------------------------------------------------------------------------
@_add("1", """
WITH words AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'),
    lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents
),
target AS (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0),
tokens AS (
  SELECT doc_id, doc_id IN (SELECT doc_id FROM target) AS t, len(w) AS n, i,
         CASE WHEN i = 1 THEN '' ELSE w[i - 1] END AS v, CASE WHEN i > len(w) THEN '' ELSE w[i] END AS w
  FROM words, unnest(range(1, len(w) + 2)) AS u(i) WHERE len(w) > 0
),
total AS (SELECT count(*) FILTER (t) AS nt, count(*) FILTER (NOT t) AS nb FROM tokens),
uni AS (SELECT w, count(*) FILTER (t) AS ct, count(*) FILTER (NOT t) AS cb FROM tokens GROUP BY w),
bi AS (SELECT v, w, count(*) FILTER (t) AS ct, count(*) FILTER (NOT t) AS cb FROM tokens GROUP BY v, w),
p AS (
  SELECT bi.v, bi.w, bi.ct, bi.cb, c.ct AS vt, c.cb AS vb,
         (u.ct + 100.0 * (u.ct + u.cb) / (nt + nb)) / (nt + 100.0) AS pt, (u.cb + 100.0 * (u.ct + u.cb) / (nt + nb)) / (nb + 100.0) AS pb
  FROM bi JOIN uni u ON u.w = bi.w JOIN uni c ON c.w = bi.v, total
)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_words,
       round(avg(ln((cb + 4.0 * pb) / (vb + 4.0)) - ln((ct + 4.0 * pt) / (vt + 4.0))), 6) AS difference
FROM documents d LEFT JOIN tokens USING (doc_id) LEFT JOIN p USING (v, w) GROUP BY d.doc_id""")
def op1_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0")
    out = entropy_difference(_table(spark, sf_dir, "documents"), good)
    return out.select("doc_id", "n_words", F.round("difference", 6).alias("difference"))


# ---- 2 -------------------------------------------------------------------------------------------
def captures(pages: DataFrame) -> DataFrame:
    """Archive records of every page: a full response, a later revisit and one from before it.

    Revisits spell the address in another way; some have another tag, a date in its place or nothing.
    """
    p, day = F.col("page_id"), 86_400
    at = F.lit(1_704_067_200) + (p * 7919) % (30 * day)
    digest = F.md5("html")
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    since = F.concat(F.lit("day "), (p % 28).cast("string"))
    html = F.array(*[F.lit(x) for x in ("Content-Type", "ETag", "Last-Modified", "Cache-Control")])

    def record(kind: int, name: str, url: Column, when: Column, status: int, headers: Column, payload: Column) -> Column:
        return F.struct(
            (p * 3 + kind).alias("record_id"), F.lit(name).alias("type"), url.alias("url"), F.timestamp_seconds(when).alias("date"),
            F.lit(status).alias("status"), headers.alias("headers"), payload.alias("payload_digest"))

    full = F.map_from_arrays(html, F.array(F.lit("text/html"), tag, since, F.lit("max-age=60")))
    renewed = F.map_from_arrays(
        F.array(F.lit("etag"), F.lit("LAST-MODIFIED"), F.lit("Cache-Control"), F.lit("Content-Length")),
        F.array(
            F.when(p % 7 == 0, '"other"').when(p % 5 != 0, F.concat(F.lit("W/"), tag)), F.when(p % 11 != 0, since),
            F.concat(F.lit("max-age="), (p % 100).cast("string")), F.lit("0")))
    again = F.concat(F.col("url"), F.when(F.col("url").contains("#"), "x").otherwise("#again"))
    none = F.lit(None).cast("string")
    each = F.array(
        record(0, "response", F.col("url"), at, 200, full, digest),
        record(1, "revisit", again, at + (p % 20 + 1) * 3600, 304, renewed, none),
        record(2, "revisit", F.regexp_replace("url", "^https?", "HTTP"), at - day, 304, renewed, none))
    return pages.select(F.inline(each))


@_add("2", r"""
WITH base AS (
  SELECT page_id AS p, url, md5(html) AS digest, '"' || substr(md5(html), 1, 16) || '"' AS tag, 'day ' || (page_id % 28) AS since,
         1704067200 + (page_id * 7919) % 2592000 AS at_s FROM pages
),
records AS (
  SELECT p * 3 AS record_id, true AS full_, url, at_s AS date, tag AS etag, since, 'max-age=60' AS cache, digest FROM base
  UNION ALL
  SELECT p * 3 + k, false, CASE k WHEN 1 THEN url || CASE WHEN contains(url, '#') THEN 'x' ELSE '#again' END ELSE regexp_replace(url, '^https?', 'HTTP') END,
         CASE k WHEN 1 THEN at_s + (p % 20 + 1) * 3600 ELSE at_s - 86400 END,
         CASE WHEN p % 7 = 0 THEN '"other"' WHEN p % 5 <> 0 THEN 'W/' || tag END, CASE WHEN p % 11 <> 0 THEN since END, 'max-age=' || (p % 100), NULL
  FROM base, (VALUES (1), (2)) AS v(k)
),
parts AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '(?s)#.*$', '') AS rest FROM records
),
canon AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '')
         || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS place,
         list_sort(list_filter(string_split(regexp_extract(rest, '(?s)\?(.*)$', 1), '&'),
           lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS query
  FROM parts
),
named AS (SELECT *, place || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END AS canonical_url FROM canon),
joined AS (
  SELECT *, last_value(CASE WHEN full_ THEN {'id': record_id, 'etag': etag, 'since': since, 'digest': digest} END IGNORE NULLS) OVER (
    PARTITION BY canonical_url ORDER BY date, full_, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o
  FROM named
),
told AS (
  SELECT *, CASE WHEN o IS NULL THEN 'no_earlier' WHEN etag IS NULL AND since IS NULL THEN 'no_validator'
    WHEN CASE WHEN etag IS NOT NULL THEN regexp_replace(etag, '^W/', '') = o.etag ELSE since = o.since END THEN 'resolved' ELSE 'changed' END AS outcome
  FROM joined WHERE NOT full_
)
SELECT record_id, canonical_url, outcome, o.id AS original_id, CASE WHEN outcome = 'resolved' THEN o.digest END AS payload_digest,
       CASE WHEN outcome = 'resolved'
         THEN 'cache-control: ' || cache || '|content-type: text/html|etag: ' || coalesce(etag, o.etag) || '|last-modified: ' || coalesce(since, o.since)
         ELSE 'cache-control: ' || cache || '|content-length: 0|etag: ' || coalesce(etag, '') || '|last-modified: ' || coalesce(since, '') END AS headers
FROM told""")
def op2_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(captures(_table(spark, sf_dir, "pages")))
    entries = F.array_sort(F.map_entries("headers"))
    shown = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "|")
    return out.withColumn("headers", shown)


# ---- 3 -------------------------------------------------------------------------------------------
@_add("3")
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"), n=3, num=90, den=100)[0]


# ---- 4 -------------------------------------------------------------------------------------------
@_add("4")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources to the square root of their rows, blocks of 16 documents."""
    out = mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source", F.xxhash64("text").cast("string").alias("text")))
    return out.select("doc_id", "source", *[F.col(c).alias(c[1:]) for c in ("_block", "_release", "_deadline", "_slot", "_position")])


# ---- 5 -------------------------------------------------------------------------------------------
@_add("5", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op5_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort(_table(spark, sf_dir, "documents"), keep="max")


# ---- 6 -------------------------------------------------------------------------------------------
@_add("6")
def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal_data(_table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans: Column) -> Column:
        name = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
        return F.array_join(F.transform(F.array_sort(spans), name), ",")

    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return out.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        hex256(joined(F.col("base"))).alias("base_sha256"),
        joined(F.concat("base", "learned")).alias("spans"),
        F.size("learned").cast("long").alias("n_learned"))


# ---- 7 -------------------------------------------------------------------------------------------
def encoded(docs: DataFrame, name: str = "byte_bpe_multi_50k.tiktoken", carry: tuple[str, ...] = ()) -> DataFrame:
    return bpe.digests(bpe.encode(docs, path=public_tokenizers.path(name), pattern=public_tokenizers.PATTERN, carry=carry))


@_add("7")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(_table(spark, sf_dir, "documents"))


# ---- 8 -------------------------------------------------------------------------------------------
@_add("8")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))
    held_out = quality.crc_fold(F.col("doc_id")) == 2
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


# ---- 9 -------------------------------------------------------------------------------------------
@_add("9")
def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 100 = 0"))


# ---- 10 ------------------------------------------------------------------------------------------
LINE_SQL = r"""
numbered AS (
  SELECT doc_id, i - 1 AS i, lines[i] AS line, trim(lines[i], chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) AS t
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM {docs}), unnest(range(1, len(lines) + 1)) AS u(i)
),
solid AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p FROM numbered WHERE t <> ''),
windows AS (
  SELECT doc_id, p, i AS lo, lead(i, 2) OVER w AS hi, t AS t0, lead(t, 1) OVER w AS t1, lead(t, 2) OVER w AS t2
  FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY p)
),
ranked AS (
  SELECT *, first_value(doc_id) OVER k AS doc0, first_value(p) OVER k AS p0 FROM windows WHERE hi IS NOT NULL
  WINDOW k AS (PARTITION BY t0, t1, t2 ORDER BY doc_id, p)
),
cuts AS (
  SELECT r.doc_id, CASE WHEN r.doc0 = r.doc_id AND r.p0 + 3 > r.p THEN s.i ELSE r.lo END AS lo, r.hi
  FROM ranked r LEFT JOIN solid s ON s.doc_id = r.doc_id AND s.p = r.p0 + 3 AND r.doc0 = r.doc_id
  WHERE (r.doc0, r.p0) <> (r.doc_id, r.p)
),
gone AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS i FROM cuts),
stay AS (
  SELECT n.doc_id, coalesce(string_agg(n.line, chr(10) ORDER BY n.i) FILTER (g.i IS NULL), '') AS text, count(*) AS n_lines, count(g.i) AS n_removed,
         coalesce(string_agg(g.i::VARCHAR, ',' ORDER BY g.i), '') AS removed
  FROM numbered n LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.i = n.i GROUP BY n.doc_id
)"""


@_add("10", f"""
WITH {LINE_SQL.format(docs="documents")}
SELECT doc_id, n_lines, n_removed, removed, sha256(text) AS text_sha256 FROM stay""")
def op10_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_windows(_table(spark, sf_dir, "documents"))
    removed = F.concat_ws(",", F.transform("removed", lambda i: i.cast("string")))
    return out.select("doc_id", "n_lines", "n_removed", removed.alias("removed"), hex256(F.coalesce("text", F.lit(""))).alias("text_sha256"))


# ---- 11 ------------------------------------------------------------------------------------------
@_add("11")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(
        _table(spark, sf_dir, "documents"), byte_level=public_tokenizers.path("byte_bpe_50k.json"),
        pieces=public_tokenizers.path("piece_bpe_32k.model"), pattern=public_tokenizers.PATTERN)


# ---- 12 ------------------------------------------------------------------------------------------
@_add("12", r"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
    lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents WHERE doc_id IS NOT NULL
),
total AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM texts WHERE len(w) > 0),
tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM texts) GROUP BY ALL),
asked AS (
  SELECT DISTINCT item_id, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL)
),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, n_docs),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term), total GROUP BY item_id, row, doc_id
)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0) WHERE rank <= 50""")
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


# ---- 13 ------------------------------------------------------------------------------------------
@_add("13", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.v, d.v)::BIGINT AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores) WHERE rank <= 20""")
def op13_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest_products(vectors, vectors.filter("vec_id % 20 = 0"))
