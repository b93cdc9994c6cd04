"""Translation memory, responses, structured documents and generated contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.functions import clean as C
from quirework.functions import text as T
from quirework.operators import assemble as A
from quirework.operators import flow as FL
from quirework.operators import memory as M
from quirework.operators import model_io as IO
from quirework.operators import planning as PL
from quirework.operators import structure as S
from quirework.plans import derived, duck
from quirework.plans import rules_sql as R
from quirework.plans.registry import query
from quirework.plans.structure_queries import classified_regions
from quirework.sources import corpus, files, pages, tables

_STAMP = "2024-02-01"


def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts, and the first line of every other document, as remembered segments."""
    key = M.memory_key(F.col("text"), "gpt-4o-mini", 0.0, "hinglish")
    bench = tables.table(spark, sf_dir, "benchmark").select("text", F.col("item_id").alias("n"))
    first = derived.lines(spark, sf_dir).filter((F.col("pos") == 0) & (F.col("doc_id") % 2 == 0)).select(
        "text", F.col("doc_id").alias("n"))
    rows = bench.unionByName(first)
    return rows.select(
        key.alias("key"), F.concat(F.lit("T:"), F.col("text")).alias("translation"),
        (F.lit(_STAMP).cast("timestamp_ntz") - F.make_dt_interval(days=(F.col("n") % 10).cast("int"))).alias("stored_at"),
    )


_MEM = f"""mem AS (SELECT text, min(n % 10) AS age FROM (SELECT text, item_id AS n FROM benchmark UNION ALL
    SELECT text, doc_id FROM lines WHERE pos = 0 AND doc_id % 2 = 0) GROUP BY text)"""


@query(
    "J2 J4",
    f"""WITH {duck.LINES}, {_MEM} SELECT doc_id, pos, sha256('gpt-4o-mini' || chr(31) || '0.000000' || chr(31) || 'hinglish'
        || chr(31) || l.text) AS key, CASE WHEN age < 7 THEN 'T:' || l.text END AS translation
    FROM lines l LEFT JOIN mem ON mem.text = l.text""",
)
def memory_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit(_STAMP).cast("timestamp_ntz")
    found = M.lookup(derived.lines(spark, sf_dir), _memory(spark, sf_dir), as_of)
    return found.select("doc_id", "pos", "key", "translation")


@query(
    "J3",
    f"""WITH {duck.LINES}, {_MEM}, d AS (SELECT text, CASE pos % 4 WHEN 0 THEN text WHEN 1 THEN ' ' ELSE 'N' || lower(substr(text, 1, 3)) END AS tr FROM lines)
    SELECT sha256('gpt-4o-mini' || chr(31) || '0.000000' || chr(31) || 'hinglish' || chr(31) || text) AS key, min(tr) AS translation
    FROM d WHERE tr <> text AND trim(tr) <> '' AND text NOT IN (SELECT text FROM mem) GROUP BY text""",
)
def memory_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, m = F.col("text"), F.col("pos") % 4
    done = derived.lines(spark, sf_dir).select("text", F.when(m == 0, text).when(m == 1, " ").otherwise(
        F.concat(F.lit("N"), F.lower(F.substring(text, 1, 3)))).alias("translation"))
    stored = M.entries_to_store(done, _memory(spark, sf_dir), F.lit(_STAMP).cast("timestamp_ntz"))
    return stored.select("key", "translation")


@query(
    "J4",
    f"""WITH {duck.LINES}, {_MEM} SELECT doc_id, pos, CASE WHEN age < 7 THEN 'T:' || l.text ELSE 'N:' || l.text END AS translation
    FROM lines l LEFT JOIN mem ON mem.text = l.text""",
)
def memory_recombined(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit(_STAMP).cast("timestamp_ntz")
    found = M.lookup(derived.lines(spark, sf_dir), _memory(spark, sf_dir), as_of)
    fresh = M.misses(found).select("key", F.concat(F.lit("N:"), F.col("text")).alias("translation"))
    return M.recombine(found, fresh).select("doc_id", "pos", "translation")


@query(
    "J7",
    """WITH s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, text FROM conversations WHERE role = 'user'),
    t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, text FROM conversations WHERE role = 'assistant')
    SELECT coalesce(s.conv_id, t.conv_id) AS doc_id, coalesce(s.pos, t.pos)::INTEGER AS pos, coalesce(s.text, chr(160)) AS source,
      coalesce(t.text, chr(160)) AS target FROM s FULL JOIN t ON s.conv_id = t.conv_id AND s.pos = t.pos""",
)
def align_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and assistant turns numbered apart (prefix sums per block of turns), then aligned."""
    from quirework.operators.ordered import Sequence, running

    c = tables.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role", "text")
    mine = F.col("role") == "user"
    counted = running(c, Sequence(("doc_id",), ("turn",), "turn div 4096"), {
        "_u": ("sum", mine.cast("int")), "_a": ("sum", (F.col("role") == "assistant").cast("int")),
    })

    def side(role: str, n: str) -> DataFrame:
        return counted.filter(F.col("role") == role).select("doc_id", (F.col(n) - 1).cast("int").alias("pos"), "text")

    return M.align_by_position(side("user", "_u"), side("assistant", "_a"))


_OUT = f"""outs AS (SELECT doc_id, pos // 5 AS batch_id, list(pos ORDER BY pos) AS idx, list('X' || text ORDER BY pos) AS tr,
    sum(length(text))::BIGINT AS used FROM lines GROUP BY ALL)"""


def _outputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Five lines to a batch; batch 1 of a document comes back short, batch 2 not at all."""
    rows = derived.lines(spark, sf_dir).withColumn("batch_id", F.expr("pos div 5"))
    packed = rows.groupBy("doc_id", "batch_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("s"), F.sum(F.length("text")).alias("usage_tokens")
    )
    out = F.transform("s", lambda x: F.concat(F.lit("X"), x["text"]))
    outputs = packed.filter(F.col("batch_id") != 2).select(
        "doc_id", "batch_id", F.col("s.pos").alias("indices"), "usage_tokens",
        F.when(F.col("batch_id") == 1, F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(out).alias("translations"),
    )
    return packed.select("doc_id", "batch_id"), outputs


@query(
    "S7",
    f"""WITH {duck.LINES} SELECT doc_id, pos AS segment_id, 'X' || text AS translation FROM lines WHERE pos // 5 NOT IN (1, 2)""",
)
def merged_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merge_batch_outputs(*_outputs(spark, sf_dir))[0]


@query(
    "S7",
    f"""WITH {duck.LINES}, {_OUT} SELECT doc_id, batch_id, CASE batch_id WHEN 1 THEN 'length_mismatch' ELSE 'missing' END AS error
    FROM outs WHERE batch_id IN (1, 2)""",
)
def output_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merge_batch_outputs(*_outputs(spark, sf_dir))[2]


@query(
    "M2",
    f"""WITH {duck.LINES}, {_OUT}, u AS (SELECT doc_id, sum(used)::BIGINT AS used FROM outs WHERE batch_id <> 2 GROUP BY 1),
    e AS (SELECT doc_id, sum(ceil(length(text) / 4.0))::BIGINT AS tokens FROM lines GROUP BY 1)
    SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND coalesce(used, 0) > 0 THEN used ELSE tokens END AS tokens FROM e LEFT JOIN u USING (doc_id)""",
)
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document reports no usage."""
    usage = M.merge_batch_outputs(*_outputs(spark, sf_dir))[1].withColumn(
        "usage_tokens", F.when(F.col("doc_id") % 3 > 0, F.col("usage_tokens")).otherwise(0)
    )
    return M.usage_or_estimate(usage, PL.document_tokens(derived.lines(spark, sf_dir)))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of two texts each, in seven shapes models answer in; one shape is cut short."""
    c = tables.table(spark, sf_dir, "conversations")
    a, b = F.col("text"), F.concat(F.lit("B "), F.col("text"))
    key = F.col("conv_id") * 100 + F.col("turn")

    def js(*pairs):
        return F.to_json(F.struct(*[v.alias(k) for k, v in pairs]))

    plain = js(("0", a), ("1", b))
    shapes = F.array(
        plain,
        js(("1", a), ("2", b)),
        F.concat(F.lit("```json\n"), plain, F.lit("\n```")),
        F.concat(F.lit('{"translations": '), js(("segment_0", a), ("segment_1", b)), F.lit("}")),
        F.to_json(F.array(F.struct(F.lit(1).alias("id"), b.alias("text")), F.struct(F.lit(0).alias("id"), a.alias("text")))),
        F.concat(F.regexp_replace(plain, r"\}$", ",}")),
        js(("0", a)),
    )
    return c.select(key.alias("batch_id"), F.lit(2).alias("n"), F.element_at(shapes, (key % 7 + 1).cast("int")).alias("content"))


@query(
    "M1",
    f"""WITH k AS (SELECT conv_id * 100 + turn AS batch_id, {duck.strip('text')} AS t FROM conversations),
    tidy AS (SELECT batch_id, array_to_string(list_transform(string_split(t, chr(10)), lambda s: {duck.squash('s')}), chr(10)) AS t FROM k WHERE batch_id % 7 <> 6)
    SELECT batch_id, 0 AS idx, t AS text FROM tidy UNION ALL SELECT batch_id, 1, 'B ' || t FROM tidy""",
)
def parsed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IO.parse_responses(_responses(spark, sf_dir))


@query("M1", "SELECT conv_id * 100 + turn AS batch_id FROM conversations WHERE (conv_id * 100 + turn) % 7 = 6")
def incomplete_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _responses(spark, sf_dir)
    return IO.incomplete_responses(r, IO.parse_responses(r)).select("batch_id")


@query(
    "M3 G8 G9",
    f"WITH {duck.LINES} SELECT doc_id, pos AS segment_id, '<' || text || '>' AS translation FROM lines",
)
def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A marking stub stands in for the model."""
    segs = derived.lines(spark, sf_dir).select(
        "doc_id", F.col("pos").alias("segment_id"), "text", T.token_count(F.col("text")).alias("tokens")
    )
    return IO.translate(PL.pack_requests(segs), segs, lambda texts: [f"<{t}>" for t in texts])


# --- headings, anchors, contents ---------------------------------------------


@query(
    "W9 F7",
    f"""WITH {derived.BOOK}, h AS (SELECT doc_id, pos, text, coalesce(nullif({duck.sub(duck.sub(f"lower({duck.strip('text')})", '[^a-z0-9]+', '-'), '^-+|-+$', '')}, ''), 'section') AS base
        FROM book WHERE type = 'heading'),
    w AS (SELECT doc_id, list(pos ORDER BY pos) AS ps, list_reduce(list_prepend(['', ''], list([base, base] ORDER BY pos)), lambda acc, x:
        list_append(acc, CASE WHEN NOT list_contains(acc[3:], x[1]) THEN x[1] ELSE x[1] || '-' ||
          list_filter(range(2, 400), lambda i: NOT list_contains(acc[3:], x[1] || '-' || i))[1] END)) AS names FROM h GROUP BY doc_id)
    SELECT doc_id, unnest(ps) AS pos, unnest(names[3:]) AS anchor FROM w""",
)
def unique_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = derived.book(spark, sf_dir).filter(F.col("type") == "heading")
    return A.unique_anchors(heads).select("doc_id", "pos", "anchor")


@query(
    "W8 D6 F5",
    f"""WITH {derived.BOOK}, heads AS (SELECT * FROM book WHERE type = 'heading'), {R.text_view('heads')},
    h AS (SELECT *, ({R.chapter_like}) AS chapter_start, greatest(2, least(6, level + 1)) AS h FROM tv WHERE NOT ({R.heading_noise})),
    d AS (SELECT *, max(chapter_start::INTEGER) OVER p AS has, min(h) OVER p AS top, min(CASE WHEN chapter_start THEN h END) OVER p AS lvl
          FROM h WINDOW p AS (PARTITION BY doc_id)),
    o AS (SELECT *, coalesce(chapter_start AND h = lvl, false) AS is_ch, bool_or(coalesce(chapter_start AND h = lvl, false)) OVER (PARTITION BY doc_id ORDER BY pos) AS opened FROM d),
    s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM o
          WHERE CASE WHEN has = 0 THEN h = top ELSE is_ch OR (opened AND h = least(6, lvl + 1)) END)
    SELECT doc_id, min(pos) AS pos, h AS level FROM s WHERE NOT ({R.prose_noise}) GROUP BY doc_id, lower(sq), h""",
)
def toc_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = derived.book(spark, sf_dir).filter(F.col("type") == "heading").select(
        "doc_id", "pos", "text", T.is_chapter_like(F.col("text")).alias("chapter_start"),
        F.greatest(F.lit(2), F.least(F.lit(6), F.col("level") + 1)).alias("h_level"), F.lit("a").alias("anchor"),
    )
    return A.toc_entries(heads).select("doc_id", "pos", "level")


@query(
    "F5",
    f"""WITH {derived.BOOK}, h AS (SELECT doc_id, pos, CASE pos % 2 WHEN 0 THEN lower(text) ELSE text END AS t, text FROM book WHERE type = 'heading'),
    s AS (SELECT *, {duck.squash('t')} AS q FROM h)
    SELECT doc_id, pos, CASE
      WHEN {duck.has('q', duck.opens('introduction'))} THEN trim('Introduction ' || ltrim(substr(q, 13)))
      WHEN {duck.has('q', duck.opens('chapter'))} THEN trim('Chapter ' || ltrim(substr(q, 8)))
      WHEN {duck.has('q', duck.opens('part'))} THEN trim('Part ' || ltrim(substr(q, 5))) ELSE q END AS shown FROM s""",
)
def display_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = derived.book(spark, sf_dir).filter(F.col("type") == "heading")
    t = F.when(F.col("pos") % 2 == 0, F.lower("text")).otherwise(F.col("text"))
    return h.select("doc_id", "pos", C.display_heading(t).alias("shown"))


# --- structured documents ------------------------------------------------------


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, _ = FL.prepared(_with_tables(spark, sf_dir))
    return A.nodes(blocks)


def _with_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book, each document followed by a table of its first two words and its whole text."""
    book = derived.book(spark, sf_dir)
    words = F.filter(F.split(T.squash(F.col("text")), " "), lambda w: w != "")
    cell = lambda i: F.coalesce(F.try_element_at(words, F.lit(i)), F.lit(""))
    tables_ = tables.documents(spark, sf_dir).select(
        "doc_id", F.lit(1_000_000_000).alias("pos"), F.lit("table").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(1).alias("level"),
        F.lit(None).cast("string").alias("list_kind"), F.lit(None).cast("int").alias("source_page"),
        F.array(F.array(cell(1), cell(2)), F.array(F.concat_ws(" ", words), F.lit(""))).alias("data"))
    return book.withColumn("data", F.lit(None).cast("array<array<string>>")).unionByName(tables_)


def _shown(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", "document_type", "title", "subtitle", F.array_join("authors", "|").alias("authors"), F.to_json("content").alias("content"))


@query("N1 N2 N3 F2 F3 F4 Q7 Q16 D3 D4")
def structured_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks to structured documents, with titles, authors and tables."""
    return _shown(FL.documents(_with_tables(spark, sf_dir)))


@query("G2 G4 G5 G8 G9 M3 N1 N2 N3")
def translated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through plan, packing, a marking stand-in for the model, and reassembly."""
    return _shown(FL.documents(_with_tables(spark, sf_dir), lambda texts: [f"<{t}>" for t in texts]))


@query("N4 Q19 Q21 P26")
def template_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.template_blocks(_nodes(spark, sf_dir)).select(
        "doc_id", "pos", "sub", "type", "text", "h_level", "chapter_start", "is_subheading", "milestone_section", "anchor",
        F.array_join("items", "\n").alias("items"),
    )


@query("Q20")
def chapter_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("pos", "sub")
    b = A.template_blocks(_nodes(spark, sf_dir)).withColumn("pos", F.row_number().over(order) - 1)
    view = A.chapter_view(b.select("doc_id", "pos", "type", "text", "chapter_start", "is_subheading"))
    return view.select("doc_id", "pos", "type", "text", "chapter_no", "display_text")


@query(
    "N5",
    f"""WITH {derived.BOOK}, {R.text_view('book')}
    SELECT doc_id, pos, CASE WHEN pos = 0 THEN 'title' WHEN pos = 1 THEN 'author' WHEN pos % 5 = 2 THEN 'toc' ELSE 'body' END AS section
    FROM tv WHERE pos % 7 <> 3 AND NOT (pos % 5 = 2 AND ({R.imprint}))""",
)
def export_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.col("pos")
    tag = F.when(pos == 0, "title").when(pos == 1, "author").when(pos % 5 == 2, "toc")
    b = derived.book(spark, sf_dir).withColumns({
        "structural_tag": tag, "action": F.when(pos % 7 == 3, "OMIT").otherwise("TRANSLATE"),
    })
    return A.export_section(b).select("doc_id", "pos", "section")


@query(
    "S2",
    """SELECT page_id AS doc_id, count(*) AS headings FROM (SELECT page_id, unnest(regexp_extract_all(html, '<h[1-6][ >]')) FROM pages) GROUP BY 1""",
)
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = pages.html_blocks(tables.dealt(tables.table(spark, sf_dir, "pages")))
    return blocks.filter(F.col("type") == "heading").groupBy("doc_id").agg(F.count(F.lit(1)).alias("headings"))


@query("S2 Q2")
def page_markup_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.html_blocks(tables.dealt(tables.table(spark, sf_dir, "pages"))).withColumn("data", F.to_json("data"))


@query(
    "S3 F8",
    """WITH n AS (SELECT doc_id, text, ['.txt', '.PDF', '.exe', '.txt', '.docx'][doc_id % 5 + 1] AS ext FROM documents)
    SELECT '/in/doc.' || doc_id || ext AS path, lower(ext) AS suffix, strlen(text) AS bytes, sha256(text) AS content_hash,
      CASE WHEN ext = '.exe' THEN 'unsupported_type' WHEN strlen(text) > 20000 THEN 'too_large' WHEN ext = '.txt' THEN 'ok' ELSE 'corrupted' END AS verdict,
      'doc.' || doc_id || '-Hindi.pdf' AS output FROM n""",
)
def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(e) for e in (".txt", ".PDF", ".exe", ".txt", ".docx")]),
                       (F.col("doc_id") % 5 + 1).cast("int"))
    raw = tables.documents(spark, sf_dir).select(
        F.concat(F.lit("/in/doc."), F.col("doc_id").cast("string"), ext).alias("path"),
        F.col("text").cast("binary").alias("content"),
    )
    return files.describe_files(raw, max_bytes=20_000).withColumn(
        "output", C.output_filename(F.col("path"), F.lit("Hindi"), F.lit(".PDF"))
    )


@query("S6")
def plan_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as JSON and read back."""
    from quirework.plans.page_queries import _SMALL, _items

    items = _items(spark, sf_dir)
    packed = PL.pack_by_tokens(PL.segments(items), _SMALL)
    back = files.read_manifests(files.plan_manifests(items, packed))
    return back.select("doc_id", "version", *[F.to_json(c).alias(c) for c in ("segments", "batches", "items")])


@query(
    "S8 N3",
    f"""WITH {duck.LINES}
    SELECT '/out/doc.' || doc_id || '.structure.json' AS path, any_value(text) FILTER (pos = 0) AS title, count(*) FILTER (pos > 0) AS nodes,
      sha256(coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (pos > 0), '')) AS content_sha256
    FROM lines GROUP BY doc_id""",
)
def document_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines as a structured document, its first line the title, written as JSON and read back."""
    none = lambda kind: F.lit(None).cast(kind)
    rows = derived.lines(spark, sf_dir).select(
        "doc_id", F.when(F.col("pos") == 0, "title").otherwise("content").alias("part"), "pos", F.lit("paragraph").alias("type"), none("int").alias("level"),
        "text", F.lit("body").alias("content_tag"), none("string").alias("kind"), F.lit(False).alias("is_quote"), none("boolean").alias("ordered"),
        none("array<string>").alias("items"), none("array<array<string>>").alias("rows"))
    docs = A.structured_documents(rows)
    named = docs.withColumn("path", F.concat(F.lit("/out/doc."), F.col("doc_id").cast("string"), F.lit(".docx")))
    back = files.structured_sidecars(named).select("path", F.from_json("document", docs.schema).alias("d"))
    texts = F.transform("d.content", lambda n: n["text"])
    return back.select("path", "d.title", F.size("d.content").cast("long").alias("nodes"), F.sha2(F.array_join(texts, "\n").cast("binary"), 256).alias("content_sha256"))


@query(
    "N6",
    f"""WITH {duck.LINES}, m AS (SELECT doc_id, list(text ORDER BY pos) AS l FROM lines GROUP BY doc_id)
    SELECT doc_id, doc_id % 4 = 0 AS use_chapters, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 0 END AS chapters,
      CASE doc_id % 4 WHEN 1 THEN array_to_string(list_transform(l, lambda x: 'paragraph|' || x), chr(10))
        WHEN 2 THEN concat_ws(chr(10), 'heading|2|' || l[1], nullif(array_to_string(list_transform(l[2:], lambda x: 'paragraph|' || x), chr(10)), ''), 'list|' || l[1] || '|true')
        ELSE '' END AS blocks FROM m""",
)
def template_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which view a template gets: chapters with content, blocks, flat fields, or nothing, by the document's number."""
    k, none = F.col("doc_id") % 4, F.lit(None)
    docs = tables.documents(spark, sf_dir).select("doc_id", F.filter(corpus.text_lines(F.col("text")), lambda t: t != "").alias("l")).filter(F.size("l") > 0)
    head, rest = F.slice("l", 1, 1), F.slice("l", F.lit(2), F.size("l"))
    listed = "array<struct<items:array<string>,ordered:boolean>>"
    chapter = lambda h, p: F.struct(h.alias("headings"), p.alias("paragraphs"), F.array().cast(listed).alias("lists"))
    bare = chapter(F.slice("l", 1, 0), F.slice("l", 1, 0))
    block = lambda t: F.struct(
        F.lit("paragraph").alias("type"), t.alias("text"), none.cast("int").alias("level"), none.cast("array<string>").alias("items"), none.cast("boolean").alias("ordered"))
    models = docs.select(
        "doc_id", F.when(k == 0, F.array(chapter(head, rest), bare)).when(k == 1, F.array(bare)).alias("chapters"),
        F.when(k == 1, F.transform("l", block)).alias("blocks"),
        F.when(k == 2, F.transform(head, lambda t: F.struct(t.alias("text"), none.cast("int").alias("level")))).alias("headings"),
        F.when(k == 2, rest).alias("paragraphs"), F.when(k == 2, F.array(F.struct(head.alias("items"), F.lit(True).alias("ordered")))).alias("lists"))
    shown = F.transform("blocks", lambda b: F.concat_ws("|", b["type"], b["level"].cast("string"), b["text"], F.array_join(b["items"], ","), b["ordered"].cast("string")))
    return A.template_view(models).select(
        "doc_id", "use_chapters", F.when(F.col("chapters").isNull(), 0).otherwise(F.size("chapters")).alias("chapters"), F.array_join(shown, "\n").alias("blocks"))
