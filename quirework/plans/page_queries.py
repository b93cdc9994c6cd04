"""Page lines, repeated lines, previews, planning and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.config import Settings
from quirework.functions import clean as C
from quirework.functions import patterns as P
from quirework.functions import text as T
from quirework.operators import dedupe as D
from quirework.operators import pages as PG
from quirework.operators import planning as PL
from quirework.operators import preview as PV
from quirework.operators.ordered import cut_lineage
from quirework.plans import derived, duck
from quirework.plans import rules_sql as R
from quirework.plans.registry import query
from quirework.plans.text_queries import SENTENCES
from quirework.sources import tables

_PER_PAGE = 6


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six lines to a page; spacing, size and weight follow the position."""
    pos, doc = F.col("pos"), F.col("doc_id")
    n = (pos % _PER_PAGE).cast("int")
    y0 = n * 12.0 + (doc * 7 + pos) % 5 * 4.0
    size = F.when((doc + pos) % 9 == 0, 19.0).when((doc + pos) % 7 == 0, 15.0).otherwise(11.0)
    font = F.when(pos % 4 == 0, "Serif-Bold").otherwise("Serif")
    flags = F.when(pos % 5 == 0, 16).otherwise(0)
    words = F.split(T.squash(F.col("text")), " ")
    head = F.array_join(F.slice(words, 1, 2), " ")
    rest = F.array_join(F.slice(words, 3, F.size(words)), " ")
    return derived.book(spark, sf_dir).select(
        "doc_id", F.expr(f"cast(pos div {_PER_PAGE} as int) + 1").alias("page"), n.alias("line_no"),
        F.lit(50.0).alias("x0"), y0.alias("y0"),
        (F.length(head) * 5.0 + 50.0).alias("x1"), (y0 + 10.0).alias("y1"),
        F.array(
            F.struct(head.alias("text"), size.alias("size"), font.alias("font"), flags.alias("flags")),
            F.struct(rest.alias("text"), F.lit(11.0).alias("size"), F.lit("Serif").alias("font"),
                     F.lit(0).alias("flags")),
        ).alias("spans"),
    )


def table_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.documents(spark, sf_dir).filter(F.col("doc_id") % 4 == 0)
    return docs.select(
        "doc_id", F.lit(1).alias("page"), F.lit(0.0).alias("x0"), F.lit(20.0).alias("y0"),
        F.lit(120.0).alias("x1"), F.lit(45.0).alias("y1"),
    )


PAGE_LINES = f"""{derived.BOOK},
pl0 AS (SELECT doc_id, pos, (pos // {_PER_PAGE} + 1)::INTEGER AS page, (pos % {_PER_PAGE})::INTEGER AS line_no,
   string_split({duck.squash('text')}, ' ') AS w,
   CASE WHEN (doc_id + pos) % 9 = 0 THEN 19.0 WHEN (doc_id + pos) % 7 = 0 THEN 15.0 ELSE 11.0 END::DOUBLE AS size,
   (pos % {_PER_PAGE}) * 12.0::DOUBLE + (doc_id * 7 + pos) % 5 * 4.0::DOUBLE AS y0 FROM book),
pl AS (SELECT *, array_to_string(w[1:2], ' ') AS head, array_to_string(w[3:], ' ') AS rest, y0 + 10.0 AS y1,
   pos % 4 = 0 OR pos % 5 = 0 AS head_bold FROM pl0),
measured AS (SELECT doc_id, page, line_no, y0, y1, trim(head || ' ' || rest) AS text,
   greatest(size, CASE WHEN rest <> '' THEN 11.0::DOUBLE ELSE size END) AS max_size,
   CASE WHEN head_bold THEN length(head) / (length(head) + length(rest))::DOUBLE ELSE 0.0 END AS bold,
   (50.0 + length(head) * 5.0 + 50.0) / 2 AS cx, (y0 + y1) / 2 AS cy FROM pl),
outside AS (SELECT * FROM measured WHERE NOT (doc_id % 4 = 0 AND page = 1 AND cx BETWEEN 0 AND 120 AND cy BETWEEN 20 AND 45)),
jumps AS (SELECT *, coalesce(abs(y0 - lag(y0) OVER (PARTITION BY doc_id, page ORDER BY line_no)) > 14, false) AS jump FROM outside),
numbered AS (SELECT *, sum(jump::INTEGER) OVER (PARTITION BY doc_id, page ORDER BY line_no)::BIGINT AS run FROM jumps),
runs AS (SELECT doc_id, page, run, string_agg(text, ' ' ORDER BY line_no) AS text, max(max_size) AS max_size,
   greatest(max(bold), avg(bold)) AS bold, min(y0) AS y0, max(y1) AS y1, count(*)::INTEGER AS lines_merged
  FROM numbered GROUP BY doc_id, page, run)"""


@query(
    "Q1 J5 A12 S4",
    f"""WITH {PAGE_LINES} SELECT doc_id, page, run, text, max_size, round(bold, 9) AS bold, y0, y1, lines_merged,
      y0 - lag(y1) OVER (PARTITION BY doc_id, page ORDER BY run) AS gap_before FROM runs""",
)
def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = PG.outside_tables(PG.line_measures(page_lines(spark, sf_dir)), table_boxes(spark, sf_dir))
    return PG.line_runs(measured).withColumn("bold", F.round("bold", 9))


FONTS = """fonts AS (SELECT doc_id, list_sort(flatten(list([size, 11.0::DOUBLE])))[len(list(size)) * 2 // 2 + 1] AS body_font
  FROM pl GROUP BY doc_id)"""


@query("A11", f"WITH {PAGE_LINES}, {FONTS} SELECT doc_id, body_font FROM fonts")
def body_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PG.body_font(page_lines(spark, sf_dir))


_bigger = "max_size >= body_font + 3.25"
_toks = duck.tokens("sq")
_strong = f"""(NOT ({R.list_line}) AND lines_merged <= 2 AND {_toks} <= 11 AND length(text) <= 160 AND NOT ({_bigger})
  AND bold >= 0.88 AND NOT ({duck.has('st', '[.!?]$')} AND {_toks} > 9) AND NOT (contains(st, ',') AND {_toks} >= 8))"""


@query(
    "Q3 P24",
    f"""WITH {PAGE_LINES}, {FONTS}, rf AS (SELECT * FROM runs JOIN fonts USING (doc_id)), {R.text_view('rf')},
    k AS (SELECT *, CASE WHEN ({R.toc_spill}) THEN 'p'
       WHEN NOT ({R.caps_emphasis}) AND {_bigger} AND {_toks} <= 22 THEN CASE WHEN max_size >= body_font + 7 THEN 'h1' ELSE 'h2' END
       WHEN NOT ({R.caps_emphasis}) AND NOT ({_bigger}) AND ({R.typographic}) THEN 'h2'
       WHEN NOT ({R.caps_emphasis}) AND {_strong} THEN CASE WHEN {_toks} <= 6 THEN 'h2' ELSE 'h3' END
       WHEN ({R.list_line}) THEN CASE WHEN {duck.has('st', rf'^[0-9]+[.)]{P.S}')} THEN 'lo' ELSE 'lb' END ELSE 'p' END AS k FROM tv)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page, run) - 1)::INTEGER AS pos, text,
      CASE k[1] WHEN 'h' THEN 'heading' WHEN 'l' THEN 'list' ELSE 'paragraph' END AS type,
      CASE WHEN k[1] = 'h' THEN k[2]::INTEGER ELSE 1 END AS level,
      CASE k WHEN 'lo' THEN 'ordered' WHEN 'lb' THEN 'bullet' END AS list_kind, page AS source_page FROM k""",
)
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = PG.page_blocks(page_lines(spark, sf_dir), table_boxes(spark, sf_dir))
    return blocks.select("doc_id", "pos", "type", "text", "level", "list_kind", "source_page")


# lines as short fragments, two to a page, so that copies recur over pages
FRAGMENTS = f"""{derived.BOOK}, frag AS (
  SELECT doc_id, pos, 'paragraph' AS type, CASE WHEN pos % 2 = 0 THEN 'Head of ' || (doc_id % 3) ELSE text END AS text,
         (pos // 2 + 1)::INTEGER AS source_page FROM book), {R.text_view('frag')},
np AS (SELECT doc_id, max(source_page) AS n FROM frag GROUP BY doc_id),
occ AS (SELECT DISTINCT doc_id, lower(sq) AS key, source_page FROM tv
        WHERE {duck.tokens('st')} BETWEEN 1 AND 14 AND length(st) <= 120 AND NOT ({R.page_number})),
isl AS (SELECT *, source_page - row_number() OVER (PARTITION BY doc_id, key ORDER BY source_page) AS i FROM occ),
lens AS (SELECT doc_id, key, i, count(*) AS len FROM isl GROUP BY ALL),
reps AS (SELECT doc_id, key, sum(len)::BIGINT AS pages, max(len) AS longest FROM lens JOIN np USING (doc_id)
         WHERE n >= 3 GROUP BY doc_id, key, n HAVING sum(len) >= greatest(6, floor(n * 0.20)) OR max(len) >= 5)"""


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = derived.book(spark, sf_dir)
    head = F.concat(F.lit("Head of "), (F.col("doc_id") % 3).cast("string"))
    return b.select(
        "doc_id", "pos", F.lit("paragraph").alias("type"),
        F.when(F.col("pos") % 2 == 0, head).otherwise(F.col("text")).alias("text"),
        F.expr("cast(pos div 2 as int) + 1").alias("source_page"),
    )


@query("D1", f"WITH {FRAGMENTS} SELECT doc_id, key, pages, longest FROM reps")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PG.repeated_fragments(_fragments(spark, sf_dir))


@query(
    "D1",
    f"""WITH {FRAGMENTS} SELECT doc_id, pos, text FROM tv t JOIN np USING (doc_id)
    WHERE NOT EXISTS (SELECT 1 FROM reps r WHERE r.doc_id = t.doc_id AND r.key = lower(t.sq))
      AND NOT (n >= 3 AND ({R.page_number}))""",
)
def fragments_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PG.drop_repeated_fragments(_fragments(spark, sf_dir)).select("doc_id", "pos", "text")


QUOTE = f"""{duck.LINES}, lp AS (SELECT doc_id, pos, 'paragraph' AS type, text, (pos // 2 + 1)::INTEGER AS source_page FROM lines),
  {R.text_view('lp')},
  np AS (SELECT doc_id, max(source_page) AS n FROM lp GROUP BY doc_id),
  occ AS (SELECT DISTINCT doc_id, lower(sq) AS key, source_page FROM tv
        WHERE {duck.tokens('st')} BETWEEN 1 AND 14 AND length(st) <= 120 AND NOT ({R.page_number})),
  isl AS (SELECT *, source_page - row_number() OVER (PARTITION BY doc_id, key ORDER BY source_page) AS i FROM occ),
  lens AS (SELECT doc_id, key, i, count(*) AS len FROM isl GROUP BY ALL),
  reps AS (SELECT doc_id, key FROM lens JOIN np USING (doc_id)
         WHERE n >= 3 GROUP BY doc_id, key, n HAVING sum(len) >= greatest(6, floor(n * 0.20)) OR max(len) >= 5),
  kept AS (SELECT t.* FROM tv t JOIN np USING (doc_id)
    WHERE NOT EXISTS (SELECT 1 FROM reps r WHERE r.doc_id = t.doc_id AND r.key = lower(t.sq))
      AND NOT (n >= 3 AND ({R.page_number})) AND NOT ({R.running_header}) AND NOT ({R.standalone_omit}))"""


@query(
    "S1 P10 P21 D1 A14 B1",
    f"""WITH {QUOTE} SELECT doc_id, count(*) AS blocks, count(*) FILTER (NOT ({R.complete})) AS open_blocks,
      sum({duck.tokens('st')})::BIGINT AS words,
      round_even((sum({duck.tokens('st')})::BIGINT / 100000.0::DOUBLE) * 99.0::DOUBLE, 0) AS payg
    FROM kept GROUP BY doc_id""",
)
def corpus_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: lines of every document, furniture removed, then words and price."""
    lines = derived.lines(spark, sf_dir).select(
        "doc_id", "pos", F.lit("paragraph").alias("type"), "text",
        F.expr("cast(pos div 2 as int) + 1").alias("source_page"),
    )
    clean, x = T.Line.prepare(PG.drop_repeated_fragments(lines))
    kept = clean.filter(~T.is_running_header(x) & ~T.is_standalone_omit(x))
    return kept.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.count_if(~T.sentence_complete(x)).alias("open_blocks"),
        F.sum(F.col("_tokens").cast("long")).alias("words"),
    ).withColumn("payg", C.payg_price(F.col("words")))


_CUM = f"""{duck.LINES}, c AS (SELECT *, {duck.tokens('text')} AS w, sum({duck.tokens('text')}) OVER
    (PARTITION BY doc_id ORDER BY pos) AS cum FROM lines)"""


@query(
    "W1 S10",
    f"""WITH {_CUM} SELECT doc_id, pos, CASE WHEN cum <= 120 THEN text ELSE array_to_string(
        regexp_extract_all(text, {duck.q(P.TOKEN)})[1:(120 - (cum - w))::BIGINT], ' ') END AS text
      FROM c WHERE cum <= 120 OR cum - w < 120""",
)
def preview_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PV.limit_words(derived.lines(spark, sf_dir), 120)


@query(
    "W2",
    f"""WITH {_CUM} SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) = 1
        OR (cum <= 780 AND cum - w < 780) AS in_preview FROM c""",
)
def preview_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PV.split_preview(derived.lines(spark, sf_dir)).select("doc_id", "pos", "in_preview")


@query("W2", f"WITH {derived.BOOK} SELECT doc_id, pos, source_page <= 3 AS in_preview FROM book")
def preview_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PV.split_preview(derived.book(spark, sf_dir), by_page=True).select("doc_id", "pos", "in_preview")


@query("F13 P2", f"""SELECT doc_id, ({duck.tokens('text')} + {duck.tokens('lang')} + {duck.tokens("coalesce(source, '') || ' x'")})::INTEGER AS words FROM documents""")
def cell_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the text and of a table row that holds language and source."""
    cells = F.array(F.array("lang", F.concat(F.coalesce("source", F.lit("")), F.lit(" x"))), F.array(F.lit(""), F.lit(None).cast("string")))
    return tables.documents(spark, sf_dir).select("doc_id", T.token_words(F.col("text"), cells).cast("int").alias("words"))


@query(
    "W3",
    f"""WITH w AS (SELECT doc_id, {duck.tokens('text')} AS words FROM documents)
    SELECT doc_id, greatest(1, (words + 259) // 260)::INTEGER AS pages, 3 AS preview_cap,
      greatest(1, (words + 259) // 260) > 3 AS preview_eligible FROM w""",
)
def preview_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tables.documents(spark, sf_dir).select("doc_id", T.token_words(F.col("text")).alias("words"))
    return PV.eligibility(w).drop("words")


@query(
    "G1 G3 P7 P8 P9",
    f"""WITH {SENTENCES}, {R.text_view('sentences')},
    s AS (SELECT doc_id, pos, sent, {duck.words('st')} AS w, {duck.cnt('st', r'[^\x00-\x7f]')} AS na,
            NOT ({R.skip}) AS send FROM tv),
    b AS (SELECT *, floor(sum(w) OVER p * 0.6) + 1 AS target, sum(CASE WHEN send THEN w ELSE 0 END) OVER p AS total,
            coalesce(sum(CASE WHEN send THEN w ELSE 0 END) OVER (PARTITION BY doc_id, pos ORDER BY w, na DESC, sent
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone
          FROM s WINDOW p AS (PARTITION BY doc_id, pos))
    SELECT doc_id, pos, sent, send AND NOT (w > 0 AND total - gone > target) AS send FROM b""",
)
def sentence_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = PL.sentence_plan(derived.lines(spark, sf_dir), ["doc_id", "pos"], 0.6)
    return plan.select("doc_id", "pos", "sent", "send")


_SMALL = Settings(
    chunk_min_tokens=20, chunk_max_tokens=60, api_word_ratio_max=0.7,
    queue_min_tokens=200, queue_max_tokens=900, queue_min_words=60, queue_max_words=200,
    request_max_input_tokens=2000, request_prompt_reserve_tokens=400, request_max_segments=6,
)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = derived.lines(spark, sf_dir).withColumns({
        "type": F.lit("paragraph"), "action": F.lit("TRANSLATE"),
    })
    return PL.plan_items(PL.translation_units(blocks, _SMALL), _SMALL)


@query("G2 G4 G5 Q17")
def plan_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir)


def _line_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.lines(spark, sf_dir).select(
        "doc_id", F.col("pos").alias("segment_id"), "text", T.token_count(F.col("text")).alias("tokens")
    )


def _pack_sql(size: str, limit: int, least: int = 0, cap: int = 0) -> str:
    """Greedy packing and both tiny-batch passes, folded over [first, len, size] triples."""
    cap_sql = f" AND acc[-1][2] < {cap}" if cap else ""
    greedy = (
        f"list_reduce(list_prepend([[-1, 0, 0]], list([[segment_id, 1, {size}]] ORDER BY segment_id)), lambda acc, x: "
        f"CASE WHEN len(acc) > 1 AND acc[-1][3] + x[1][3] <= {limit}{cap_sql} "
        "THEN list_append(acc[1:len(acc) - 1], [acc[-1][1], acc[-1][2] + 1, acc[-1][3] + x[1][3]]) "
        "ELSE list_append(acc, x[1]) END)[2:]"
    )
    if not least:
        return f"SELECT doc_id, {greedy} AS b FROM segs GROUP BY doc_id"
    merge = (
        "list_reduce(list_transform({src}, lambda t: [t]), lambda acc, x: "
        f"CASE WHEN acc[-1][3] < {least} AND acc[-1][3] + x[1][3] <= {limit} "
        "THEN list_append(acc[1:len(acc) - 1], [{first}, acc[-1][2] + x[1][2], acc[-1][3] + x[1][3]]) "
        "ELSE list_append(acc, x[1]) END)"
    )
    back = merge.format(src="list_reverse(b)", first="x[1][1]")
    fore = merge.format(src="list_reverse(b)", first="acc[-1][1]")
    return (
        f"SELECT doc_id, {fore} AS b FROM (SELECT doc_id, {back} AS b FROM "
        f"(SELECT doc_id, {greedy} AS b FROM segs GROUP BY doc_id))"
    )


def _packed(size: str, limit: int, least: int = 0, cap: int = 0) -> str:
    return f"""WITH {duck.LINES}, segs AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS segment_id,
        pos, {size}::BIGINT AS n FROM lines), packed AS ({_pack_sql('n', limit, least, cap)})
    SELECT doc_id, (generate_subscripts(b, 1) - 1)::INTEGER AS batch_id, unnest(b)[2]::INTEGER AS segments,
           unnest(b)[3] AS size FROM packed"""


def _shape(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "batch_id", F.size("segment_ids").alias("segments"), "size")


@query("G6", _packed("ceil(length(text) / 4.0) + 80", 900, 200))
def pack_by_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(PL.pack_by_tokens(_line_segments(spark, sf_dir), _SMALL))


@query("G7", _packed(duck.words("text"), 200, 60))
def pack_by_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(PL.pack_by_words(_line_segments(spark, sf_dir), _SMALL))


@query("G8", _packed("ceil(length(text) / 4.0) + 80", 1600, 0, 6))
def pack_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shape(PL.pack_requests(_line_segments(spark, sf_dir), _SMALL))


@query(
    "G10 G11",
    f"""WITH {duck.LINES}, t AS (SELECT doc_id, sum(ceil(length(text) / 4.0))::BIGINT AS tokens, count(*) AS n
        FROM lines GROUP BY doc_id)
    SELECT doc_id, tokens, tokens <= 5000 AS admitted, least(16384, CASE WHEN n = 1
        THEN greatest(384, floor(tokens * 2.5) + 400)
        ELSE greatest(768, floor(tokens * 2.75) + 850 + least(6000, n * 14 + 320)) END)::INTEGER AS budget FROM t""",
)
def document_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = derived.lines(spark, sf_dir)
    counts = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    tokens = PL.document_tokens(lines, Settings(max_tokens_per_job=5000))
    return tokens.join(counts, "doc_id").select(
        "doc_id", "tokens", "admitted", PL.completion_budget(F.col("tokens"), F.col("n")).alias("budget")
    )


@query(
    "G9",
    f"""WITH {SENTENCES} SELECT doc_id, pos AS block_pos,
      string_agg(CASE WHEN sent % 3 = 1 THEN upper(text) ELSE text END, ' ' ORDER BY sent) AS text
    FROM (SELECT doc_id, pos, sent, CASE WHEN sent % 3 = 1 THEN regexp_replace(text, '[^A-Za-z ]', '', 'g') ELSE text END AS text
          FROM sentences) GROUP BY doc_id, pos""",
)
def reassembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third sentence is a job "translated" to capitals; the rest stay verbatim."""
    rows = derived.lines(spark, sf_dir).select(
        "doc_id", F.col("pos").alias("block_pos"), F.posexplode(T.split_sentences(F.col("text"))).alias("item", "text")
    )
    job = F.col("item") % 3 == 1
    items = rows.select(
        "doc_id", "block_pos", F.lit(-1).alias("row"), F.lit(-1).alias("col"), F.lit(0).alias("para"), "item",
        F.when(job, "job").otherwise("skip").alias("kind"), "text",
        F.when(job, F.col("block_pos") * 100000 + F.col("item")).alias("segment_id"),
    )
    shout = F.upper(F.regexp_replace("text", "[^A-Za-z ]", ""))
    done = items.filter(F.col("kind") == "job").select("doc_id", "segment_id", shout.alias("translation"))
    return PL.reassemble(items, done).select("doc_id", "block_pos", "text")


@query(
    "D2",
    f"""WITH {derived.BOOK},
    cutp AS (SELECT doc_id, pos * 2 AS pos, type, substr(text, 1, (length(text) * 7) // 10) AS text FROM book WHERE pos % 3 = 0
             UNION ALL SELECT doc_id, pos * 2 + 1, type, text FROM book),
    n AS (SELECT doc_id, pos, type, {duck.strip('text')} AS b FROM cutp),
    k AS (SELECT *, translate(lower({duck.squash('b')}), {duck.q(P.OVERLAP_QUOTES)}, '') AS nb FROM n),
    p AS (SELECT doc_id, pos, b, nb, lag(pos) OVER w AS prev_pos, lag(b) OVER w AS a, lag(nb) OVER w AS na,
            type = 'paragraph' AND b <> '' AND lag(type) OVER w = 'paragraph' AND lag(b) OVER w <> '' AS both_ FROM k
          WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    o AS (SELECT *, length(a) <= length(b) AS prev_shorter,
          CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN na ELSE nb END AS ns,
          CASE WHEN length(a) <= length(b) THEN nb ELSE na END AS nl,
          string_split(lower({duck.squash('a')}), ' ') AS wa, string_split(lower({duck.squash('b')}), ' ') AS wb
          FROM p WHERE both_ AND length(a) >= 24 AND length(b) >= 24),
    j AS (SELECT *, least(len(wa), len(wb)) AS k FROM o WHERE length(nl) - length(ns) >= 18),
    f AS (SELECT *, CASE WHEN k >= 6 THEN len(list_intersect(list_distinct(wa[1:k]), list_distinct(wb[1:k])))
            / len(list_distinct(wa[1:k] || wb[1:k]))::DOUBLE ELSE 0.0 END AS jac,
          starts_with(nl, ns) AND length(ns) >= 24 AND NOT {duck.has('s', '[.!?]$')} AS hit FROM j)
    SELECT doc_id, prev_pos, pos, prev_shorter, round(jac, 6) AS jaccard, hit AS prefix_hit,
      NOT hit AND length(s) >= 20 AND ({duck.cnt('s', chr(34))} % 2 = 1 OR {duck.cnt('s', '“')} > {duck.cnt('s', '”')})
        AND jac >= 0.48 AND length(ns) >= 36 AS fuzzy_candidate FROM f""",
)
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.overlap_pairs(_with_truncated_copies(spark, sf_dir))


def _with_truncated_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third block is preceded by its own first seven tenths."""
    b = derived.book(spark, sf_dir)
    text, pos = F.col("text"), F.col("pos")
    cut = F.substring(text, F.lit(1), F.floor(F.length(text) * 7 / 10).cast("int"))
    both = F.when(pos % 3 == 0, F.array(
        F.struct((pos * 2).alias("pos"), cut.alias("text")), F.struct((pos * 2 + 1).alias("pos"), text.alias("text"))
    )).otherwise(F.array(F.struct((pos * 2 + 1).alias("pos"), text.alias("text"))))
    return b.select("doc_id", "type", F.inline(both)).withColumns({
        "action": F.lit("TRANSLATE"), "structural_tag": F.lit(None).cast("string"),
    })


@query("D3 D4")
def near_duplicates_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Read by the interiors, the rounds and the result.
    return D.dedupe_paragraphs(cut_lineage(_with_truncated_copies(spark, sf_dir))).select("doc_id", "pos", "text")


@query(
    "D7",
    f"""WITH {derived.BOOK},
    noisy AS (SELECT doc_id, pos, CASE pos % 4
        WHEN 0 THEN 'to=json code to = json code to=json code' || chr(10) || text
        WHEN 1 THEN 'WHITE NIGHTS WHITE NIGHTS ' || pos || chr(10) || chr(10) || chr(10) || chr(10) || text
        WHEN 2 THEN text || '  assistant to=json code to=json code  end' ELSE text END AS text FROM book)
    SELECT doc_id, pos, trim(CASE pos % 4 WHEN 0 THEN t WHEN 1 THEN t WHEN 2 THEN t ELSE t END, chr(10) || ' ') AS text FROM (
      SELECT doc_id, pos, array_to_string(list_transform(list_filter(string_split(text, chr(10)),
         lambda s: NOT starts_with(s, 'to=json code to') AND NOT starts_with(s, 'WHITE NIGHTS WHITE')),
         lambda s: {duck.squash("replace(s, 'assistant to=json code to=json code', '')")}), chr(10)) AS t0,
         regexp_replace(t0, '\\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM noisy)""",
)
def sanitized_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = derived.book(spark, sf_dir)
    text, pos = F.col("text"), F.col("pos")
    noisy = (
        F.when(pos % 4 == 0, F.concat(F.lit("to=json code to = json code to=json code\n"), text))
        .when(pos % 4 == 1, F.concat(F.lit("WHITE NIGHTS WHITE NIGHTS "), pos.cast("string"), F.lit("\n\n\n\n"), text))
        .when(pos % 4 == 2, F.concat(text, F.lit("  assistant to=json code to=json code  end")))
        .otherwise(text)
    )
    return b.select("doc_id", "pos", C.sanitize_output(noisy).alias("text"))


@query(
    "D5",
    """WITH u AS (SELECT source AS user_id, sha256(text) AS content_hash, doc_id AS upload_id FROM documents),
    j AS (SELECT source AS user_id, sha256(text) AS content_hash, doc_id AS id,
            CASE doc_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'cancelled' END AS status
          FROM documents WHERE doc_id % 2 = 0),
    k AS (SELECT user_id, content_hash, min(id) FILTER (status = 'completed') AS live_id,
            min(id) FILTER (status = 'failed') AS failed_id FROM j GROUP BY ALL),
    a AS (SELECT user_id, content_hash, min(upload_id) AS first_upload, count(*) AS uploads FROM u GROUP BY ALL)
    SELECT user_id, content_hash, first_upload, uploads, CASE WHEN live_id IS NOT NULL THEN 'existing'
      WHEN failed_id IS NOT NULL THEN 'retry' ELSE 'new' END AS outcome, coalesce(live_id, failed_id) AS job_id
    FROM a LEFT JOIN k USING (user_id, content_hash)""",
)
def upload_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier jobs exist for every other document; sources act as users."""
    d = tables.documents(spark, sf_dir).select(
        F.col("source").alias("user_id"), F.sha2("text", 256).alias("content_hash"), F.col("doc_id").alias("upload_id")
    )
    m = F.col("upload_id") % 3
    earlier = d.filter(F.col("upload_id") % 2 == 0).select(
        "user_id", "content_hash", F.col("upload_id").alias("id"),
        F.when(m == 0, "completed").when(m == 1, "failed").otherwise("cancelled").alias("status"),
    )
    return D.upload_outcomes(d, earlier)
