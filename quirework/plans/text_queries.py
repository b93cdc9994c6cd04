"""Row-level text rules over document lines and book-like blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import clean as C
from quirework.functions import patterns as P
from quirework.functions import text as T
from quirework.plans import derived, duck
from quirework.plans import rules_sql as R
from quirework.plans.registry import query
from quirework.sources import corpus, tables

_FLAGS = {
    "complete": (T.sentence_complete, R.complete),
    "continuation": (T.is_continuation, R.continuation),
    "section_label": (T.is_section_label, R.section_label),
    "citation": (T.is_citation_heavy, R.citation),
    "symbol_heavy": (T.is_symbol_heavy, R.symbol_heavy),
    "skip": (T.skip_sentence, R.skip),
    "running_header": (T.is_running_header, R.running_header),
    "toc_trigger": (T.is_toc_trigger, R.toc_trigger),
    "toc_standalone": (T.is_toc_standalone, R.toc_standalone),
    "milestone": (T.is_milestone_heading, R.milestone),
    "imprint": (T.is_imprint, R.imprint),
    "leader_row": (T.is_toc_leader_row, R.leader_row),
    "heading_noise": (T.is_toc_heading_noise, R.heading_noise),
    "listing_row": (T.is_toc_listing_row, R.listing_row),
    "row_in_contents": (T.is_toc_row_in_contents, R.row_in_contents),
    "merged_blob": (T.is_merged_toc_blob, R.merged_blob),
    "body_opener": (T.is_toc_body_opener, R.body_opener),
    "back_matter": (T.is_back_matter_heading, R.back_matter),
    "standalone_omit": (T.is_standalone_omit, R.standalone_omit),
    "copyright_block": (T.is_copyright_block, R.copyright_block),
    "distributor": (T.is_distributor_boilerplate, R.distributor),
    "chapter_like": (T.is_chapter_like, R.chapter_like),
    "caps_emphasis": (T.is_caps_emphasis, R.caps_emphasis),
    "typographic": (T.is_typographic_heading, R.typographic),
    "toc_spill": (T.is_toc_spill, R.toc_spill),
    "list_line": (T.is_list_line, R.list_line),
    "page_number": (T.is_page_number, R.page_number),
    "leader_or_leaf": (T.is_toc_leader_or_leaf, R.leader_or_leaf),
    "prose_noise": (T.is_toc_prose_noise, R.prose_noise),
    "truncated": (T.is_likely_truncated, R.truncated),
    "quote_opening": (T.opens_with_quote, R.quote_opening),
    "supports_heading": (T.supports_heading, R.supports_heading),
}


@query(
    "P4-P10 P12-P18 P20-P25 P27-P29",
    f"WITH {derived.BOOK}, {R.text_view('book')} SELECT doc_id, pos, "
    + ", ".join(f"({sql}) AS {name}" for name, (_, sql) in _FLAGS.items())
    + " FROM tv",
)
def line_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, text = T.Line.prepare(derived.book(spark, sf_dir))
    return blocks.select(
        "doc_id", "pos", *[rule(text).alias(name) for name, (rule, _) in _FLAGS.items()]
    )


@query(
    "P1 P2 P3 A14",
    f"""SELECT doc_id, {duck.words('text')} AS words, {duck.tokens('text')} AS token_words,
        ceil(length(text) / 4.0)::INTEGER AS tokens FROM documents""",
)
def doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return tables.documents(spark, sf_dir).select(
        "doc_id",
        T.word_count(text).alias("words"),
        T.token_words(text).alias("token_words"),
        T.token_count(text).alias("tokens"),
    )


@query(
    "A14 B1 B2 F15",
    f"""WITH w AS (SELECT doc_id, {duck.tokens('text')} AS words FROM documents)
    SELECT doc_id, words, round_even((words / 100000.0::DOUBLE) * 99.0::DOUBLE, 0) AS payg,
      ceil(greatest(5.0, words * 0.75 / 10000.0 * 9.9) * 100) / 100.0 AS estimate,
      round_even((ceil(greatest(5.0, words * 0.75 / 10000.0 * 9.9) * 100) / 100.0) * 100, 0)::INTEGER AS cents
    FROM w""",
)
def doc_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tables.documents(spark, sf_dir).select("doc_id", T.token_words(F.col("text")).alias("words"))
    return w.select(
        "doc_id", "words",
        C.payg_price(F.col("words")).alias("payg"),
        C.token_price(F.col("words")).alias("estimate"),
        C.minor_units(C.token_price(F.col("words"))).alias("cents"),
    )


@query("S1", f"WITH {duck.LINES} SELECT doc_id, pos, 'paragraph' AS type, text FROM lines")
def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus holds no bulleted line, so every block here is a paragraph."""
    return corpus.line_blocks(tables.documents(spark, sf_dir)).select("doc_id", "pos", "type", "text")


# ten bulleted lines per stanza of conversation text, to exercise list typing
_BULLETED = r"""
turns AS (
  SELECT conv_id, turn,
    CASE turn % 3 WHEN 0 THEN '- ' || replace(text, chr(10), chr(10) || '- ')
                  WHEN 1 THEN '1. ' || replace(text, chr(10), chr(10) || '2) ')
                  ELSE text END AS text
  FROM conversations
)"""


@query(
    "S1",
    f"""WITH {_BULLETED},
    l AS (SELECT conv_id * 100 + turn AS doc_id, {duck.strip('text')} AS body, turn % 3 AS m FROM turns),
    x AS (SELECT *, list_filter(string_split(body, chr(10)), lambda s: {duck.has('s', P.NS)}) AS ls FROM l),
    y AS (SELECT *, len(list_filter(ls, lambda s: NOT {duck.has(duck.strip('s'), rf'^(?:[-*•]|\d+[.)]){P.S}+')})) = 0
              AS is_list,
            len(list_filter(ls, lambda s: NOT {duck.has(duck.strip('s'), rf'^\d+[.)]{P.S}+')})) = 0 AS numbered
          FROM x)
    SELECT doc_id, CASE WHEN is_list THEN 'list' ELSE 'paragraph' END AS type,
      CASE WHEN is_list THEN array_to_string(list_transform(ls, lambda s:
        regexp_replace(regexp_replace({duck.strip('s')}, {duck.q(rf'^\d+[.)]{P.S}+')}, ''),
                       {duck.q(rf'^[-*•]{P.S}+')}, '')), chr(10)) ELSE body END AS text,
      CASE WHEN is_list AND numbered THEN 'ordered' WHEN is_list THEN 'bullet' END AS list_kind
    FROM y""",
)
def list_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.table(spark, sf_dir, "conversations")
    text = F.col("text")
    marked = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("- "), F.replace(text, F.lit("\n"), F.lit("\n- "))))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit("1. "), F.replace(text, F.lit("\n"), F.lit("\n2) "))))
        .otherwise(text)
    )
    docs = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), marked.alias("text"))
    return corpus.text_blocks(docs).select("doc_id", "type", "text", "list_kind")


def _protect(x: str) -> str:
    for a in P.ABBREVIATIONS:
        x = f"replace({x}, {duck.q(a)}, {duck.q(a[:-1])} || chr(31))"
    return x


SENTENCES = f"""{duck.LINES},
raw_sentences AS (
  SELECT doc_id, pos,
    unnest(string_split(regexp_replace({_protect('text')}, {duck.q(P.SENTENCE_BREAK)}, '\\1' || chr(30), 'g'), chr(30))) AS s,
    generate_subscripts(string_split(regexp_replace({_protect('text')}, {duck.q(P.SENTENCE_BREAK)}, '\\1' || chr(30), 'g'),
      chr(30)), 1) - 1 AS sent
  FROM lines),
sentences AS (SELECT doc_id, pos, sent, {duck.strip("replace(s, chr(31), '.')")} AS text FROM raw_sentences
              WHERE {duck.strip('s')} <> '')"""


@query("G1", f"WITH {SENTENCES} SELECT doc_id, pos, sent, text FROM sentences")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.lines(spark, sf_dir).select(
        "doc_id", "pos", F.posexplode(T.split_sentences(F.col("text"))).alias("sent", "text")
    )


@query(
    "P11 Q6",
    f"""WITH {derived.BOOK}, {R.text_view('book')},
    led AS (SELECT *, string_split(sq, ' ') AS w, {R.nav_lead} AS n FROM tv),
    kept AS (SELECT * FROM led WHERE NOT (type IN ('paragraph', 'list', 'heading') AND ({R.running_header})))
    SELECT doc_id, pos, type,
      CASE WHEN type <> 'paragraph' THEN text
           WHEN len(w) < 3 OR n < 2 OR n >= len(w)
             OR (n = 2 AND lower({duck.sub('w[3]', f'^[^{P.WORD_CHARS}]+|[^{P.WORD_CHARS}]+$', '')})
                 IN ({', '.join(duck.q(g) for g in P.NAV_GUARD_WORDS)}))
           THEN st ELSE array_to_string(w[n + 1:], ' ') END AS text
    FROM kept""",
)
def page_furniture_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirework.operators.pages import drop_page_furniture

    return drop_page_furniture(derived.book(spark, sf_dir)).select("doc_id", "pos", "type", "text")


@query(
    "P26",
    f"WITH {derived.BOOK}, {R.text_view('book')} SELECT doc_id, pos, {R.outline_items} AS items FROM tv "
    f"WHERE {R.outline_items} IS NOT NULL",
)
def outline_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = T.decimal_outline_split(F.col("text"))
    return (
        derived.book(spark, sf_dir)
        .select("doc_id", "pos", F.array_join(items, " / ").alias("items"))
        .filter(F.col("items").isNotNull())
    )


@query(
    "P19",
    f"""WITH {derived.BOOK},
    paired AS (SELECT b.doc_id, b.pos,
                 CASE WHEN b.pos % 2 = 0 THEN 'Contents' ELSE b.text END AS head, string_split(n.text, chr(10))[1] AS text
               FROM book b LEFT JOIN book n ON n.doc_id = b.doc_id AND n.pos = b.pos + 1),
    {R.text_view('paired')}
    SELECT doc_id, pos,
      (lower({duck.squash("string_split(head, chr(10))[1]")}) IN ({', '.join(duck.q(t) for t in P.TOC_TITLES)})
       AND CASE WHEN head LIKE '%' || chr(10) || '%' THEN false
                WHEN coalesce(text, '') = '' THEN true
                ELSE ({R.leader_row}) OR ({R.listing_row}) END) AS opens_contents
    FROM tv""",
)
def contents_openers(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = derived.book(spark, sf_dir)
    nxt = b.select("doc_id", (F.col("pos") - 1).alias("pos"), F.col("text").alias("next_text"))
    pair = b.join(nxt, ["doc_id", "pos"], "left")
    head = F.when(F.col("pos") % 2 == 0, "Contents").otherwise(F.col("text"))
    both = F.concat(head, F.lit("\n"), F.coalesce(F.col("next_text"), F.lit("")))
    return pair.select("doc_id", "pos", T.starts_contents_region(both).alias("opens_contents"))


@query(
    "F1 F6 F7 F9 F10 F14",
    f"""WITH {derived.BOOK} SELECT doc_id, pos,
      nfc_normalize({duck.sub("text", "[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}]", ' ')}) AS cleaned,
      translate(lower({duck.squash('text')}), {duck.q(P.OVERLAP_QUOTES)}, '') AS overlap_key,
      coalesce(nullif({duck.sub(duck.sub(f"lower({duck.strip('text')})", '[^a-z0-9]+', '-'), '^-+|-+$', '')}, ''),
               'section') AS slug,
      CASE WHEN pos % 3 = 0 THEN 'hindi' ELSE 'hinglish' END AS target,
      substr({duck.strip('text')}, 1, 40) AS short,
      CASE WHEN type = 'heading' AND level > 1
           THEN least(72.0, (level - 1) * 12.0 + 6.0 * length(regexp_extract(text, '^ +')))
           WHEN {duck.has('text', rf'^\d+(\.\d+)*{P.S}')}
           THEN least(72.0, 14.0 * len(regexp_extract_all(regexp_extract(text, '^[0-9.]+'), '\\.')))
           ELSE least(48.0, 6.0 * length(regexp_extract(text, '^ +'))) END::DOUBLE AS indent
    FROM book""",
)
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    raw_target = F.element_at(
        F.array(F.lit(" Hi "), F.lit("Hinglish"), F.lit("")), (F.col("pos") % 3 + 1).cast("int")
    )
    return derived.book(spark, sf_dir).select(
        "doc_id", "pos",
        C.clean_control_chars(text, nfc=True).alias("cleaned"),
        C.overlap_key(text).alias("overlap_key"),
        C.slug(text).alias("slug"),
        C.translation_target(raw_target).alias("target"),
        C.optional_text(text, 40).alias("short"),
        C.outline_indent(text, F.col("type") == "heading", F.col("level")).alias("indent"),
    )
