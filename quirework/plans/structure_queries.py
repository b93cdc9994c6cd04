"""Contents regions, section actions, headings and outline over book-like blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import patterns as P
from quirework.functions import text as T
from quirework.operators import classify as CL
from quirework.operators import marks as MK
from quirework.operators import merging as M
from quirework.operators import structure as S
from quirework.operators.ordered import cut_lineage
from quirework.plans import derived, duck
from quirework.plans import rules_sql as R
from quirework.plans.registry import query

_prose = "type IN ('paragraph', 'list')"
_label = (
    f"(length(st) < 120 AND ({R.toc_standalone}) AND NOT {duck.has('st', P.SENTENCE_THEN_CAPITAL)})"
)
_f0 = f"((type = 'heading' AND ({R.toc_trigger})) OR ({_prose} AND {_label}))"
_f1 = f"""((type = 'heading' AND (({R.toc_trigger}) OR ({R.row_in_contents})))
  OR ({_prose} AND NOT ({R.imprint}) AND NOT ({R.merged_blob}) AND {duck.words('st')} < 40 AND length(st) < 320
      AND NOT ({R.body_opener}) AND ({R.listing_row})))"""
# the region state is folded row by row here, unlike the window arithmetic it checks
REGIONS = f"""{derived.BOOK}, {R.text_view('book')},
flags AS (SELECT *, ({_f0})::INTEGER AS f0, ({_f1})::INTEGER AS f1, ({R.merged_blob}) AS blob,
                 ({R.imprint}) AS imprint FROM tv),
walk AS (SELECT doc_id, list(pos ORDER BY pos) AS ps,
    list_reduce(list_prepend([0], list([f0, f1] ORDER BY pos)),
      lambda acc, x: list_append(acc, CASE WHEN acc[-1] = 1 THEN x[2] ELSE x[1] END)) AS st8 FROM flags GROUP BY doc_id),
before AS (SELECT doc_id, unnest(ps) AS pos, unnest(st8[1:len(ps)]) AS was FROM walk),
regions AS (SELECT f.*, (CASE WHEN was = 1 THEN f1 = 1 OR ({_prose} AND blob AND NOT imprint) ELSE f0 = 1 END
              OR (blob AND type IN ('paragraph', 'heading'))) AS toc
            FROM flags f JOIN before USING (doc_id, pos))"""


def _tagged(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Blocks with contents regions only, the part the SQL checks restate, and with marks."""
    regions = S.contents_region(MK.marked(derived.book(spark, sf_dir), *MK.REGION, *names))
    return regions.withColumn("structural_tag", F.when(F.col("_toc"), "toc")).drop("_toc")


@query("Q7", f"WITH {REGIONS} SELECT doc_id, pos, toc FROM regions")
def contents_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.contents_region(derived.book(spark, sf_dir)).select("doc_id", "pos", F.col("_toc").alias("toc"))


_walk12 = "list_prepend([0], list([back, closer, level] ORDER BY pos))"
ACTIONS = f"""{REGIONS},
early AS (SELECT *, CASE WHEN toc THEN CASE WHEN imprint THEN 'OMIT' ELSE 'SKIP' END
     WHEN ({R.running_header}) THEN 'OMIT'
     WHEN {_prose} AND {duck.words('st')} <= 14 AND imprint THEN 'OMIT' END AS early FROM regions),
heads AS (SELECT *, (early IS NULL AND type = 'heading' AND ({R.back_matter}))::INTEGER AS back,
     (early IS NULL AND type = 'heading' AND NOT ({R.back_matter}))::INTEGER AS closer FROM early),
walk12 AS (SELECT doc_id, list(pos ORDER BY pos) AS ps, list_reduce({_walk12},
     lambda acc, x: list_append(acc, CASE WHEN x[1] = 1 THEN x[3]
        WHEN x[2] = 1 AND acc[-1] > 0 AND x[3] <= acc[-1] THEN 0 ELSE acc[-1] END)) AS lv FROM heads GROUP BY doc_id),
levels AS (SELECT doc_id, unnest(ps) AS pos, unnest(lv[2:]) AS skip_level FROM walk12),
classified AS (SELECT doc_id, pos, type, text, level, st, sq,
     CASE WHEN toc AND NOT imprint THEN 'toc' END AS structural_tag,
     coalesce(early, CASE WHEN skip_level > 0 THEN 'OMIT'
       WHEN {_prose} AND ({R.standalone_omit}) THEN 'OMIT'
       WHEN {_prose} AND ({R.copyright_block}) THEN 'OMIT'
       WHEN ({R.distributor}) THEN 'OMIT' ELSE 'TRANSLATE' END) AS action
   FROM heads JOIN levels USING (doc_id, pos))"""


def classified_regions(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Classified blocks; with the marks ``names``, if any are asked for, from the same look at the texts."""
    none = spark.createDataFrame([], "doc_id bigint, pos int")
    rows = CL.classify(_tagged(spark, sf_dir, *MK.SECTIONS, *names), inventory=none)
    return rows if names else MK.unmarked(rows)


@query("Q12 P21 P22", f"WITH {ACTIONS} SELECT doc_id, pos, action, structural_tag FROM classified")
def section_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified_regions(spark, sf_dir).select("doc_id", "pos", "action", "structural_tag")


@query("Q7 Q8 Q11 Q12")
def book_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full tagging and classification; checked against brute force in the tests."""
    tagged = S.tag_book_structure(MK.marked(
        derived.book(spark, sf_dir), *MK.REGION, *MK.ORPHANS, *MK.TITLES, *MK.INVENTORY, *MK.SECTIONS))
    # The inventories and what joins them read the same rows, which hold marks and no text from here on.
    return CL.classify(cut_lineage(tagged.select("doc_id", "pos", "type", "level", "structural_tag", *MK.COLUMNS))).select("doc_id", "pos", "structural_tag", "action")


@query("Q11")
def part_inventories(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = derived.book(spark, sf_dir).withColumn("structural_tag", F.lit(None).cast("string"))
    return CL.part_inventory(plain)


_backed = f"""(lead(action = 'TRANSLATE' AND {R.supports_heading}) OVER (PARTITION BY doc_id ORDER BY pos)
  AND NOT contains(sq, ' ') AND {R.in_list('lower(sq)', P.AMBIGUOUS_WORDS)})"""
DEMOTED = f"""{ACTIONS},
judged AS (SELECT *, action = 'TRANSLATE' AND type = 'heading' AND st <> '' AND structural_tag IS NULL
   AND NOT coalesce({_backed}, false)
   AND ({duck.words('st')} > 26 OR (({R.multi_sentence}) AND {duck.words('st')} > 12)
        OR (NOT ({R.chapter_like}) AND (({duck.has('st', '[,;]$')} AND {duck.words('st')} > 9)
            OR (contains(st, ',') AND {duck.words('st')} >= 6)))) AS demoted FROM classified),
demoted AS (SELECT doc_id, pos, CASE WHEN demoted THEN 'paragraph' ELSE type END AS type, text, st, sq,
   CASE WHEN demoted THEN 1 ELSE level END AS level, structural_tag, action,
   CASE WHEN demoted THEN 'paragraph' END AS semantic_role FROM judged)"""


@query("Q13", f"WITH {DEMOTED} SELECT doc_id, pos, type, level, semantic_role FROM demoted")
def false_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.demote_false_headings(classified_regions(spark, sf_dir)).select(
        "doc_id", "pos", "type", "level", "semantic_role"
    )


@query(
    "Q15 P29",
    f"""WITH {DEMOTED},
    kinds AS (SELECT *, CASE WHEN action = 'OMIT' OR structural_tag = 'toc' THEN 0
        WHEN type = 'heading' AND ({R.chapter_like}) THEN 1 WHEN type = 'heading' THEN 2 ELSE 3 END AS k FROM demoted),
    walk15 AS (SELECT doc_id, list(pos ORDER BY pos) AS ps, list_reduce(list_prepend([0], list([k] ORDER BY pos)),
        lambda acc, x: list_append(acc, CASE WHEN x[1] = 0 THEN acc[-1] WHEN x[1] = 2 AND acc[-1] IN (2, 4) THEN 4
                                             ELSE x[1] END)) AS leaf FROM kinds GROUP BY doc_id),
    leaves AS (SELECT doc_id, unnest(ps) AS pos, unnest(leaf[2:]) AS leaf FROM walk15)
    SELECT doc_id, pos,
      CASE WHEN k NOT IN (1, 2) THEN level WHEN leaf = 1 THEN 1 WHEN leaf = 2 THEN 2 ELSE 3 END AS level,
      CASE WHEN k = 1 THEN 'chapter' WHEN k = 2 AND leaf = 4 THEN 'subheading' WHEN k = 2 THEN 'heading'
           WHEN semantic_role IS NULL AND action = 'TRANSLATE' AND type = 'paragraph' AND {R.quote_opening} THEN 'quote'
           ELSE semantic_role END AS semantic_role
    FROM kinds JOIN leaves USING (doc_id, pos)""",
)
def outline_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, _ = S.enrich(classified_regions(spark, sf_dir))
    return blocks.select("doc_id", "pos", "level", "semantic_role")


@query(
    "Q14",
    f"""WITH {derived.BOOK}, {R.text_view('book')},
    flagged AS (SELECT *,
       bool_or(type = 'heading' AND ({R.toc_trigger})) OVER w AS toc_yet,
       CASE WHEN type = 'heading' THEN {duck.words('st')} <= 14 AND length(st) <= 120 AND NOT ({R.chapter_like})
            WHEN type = 'paragraph' THEN {duck.words('st')} BETWEEN 2 AND 22 AND length(st) <= 200
                 AND NOT {duck.has('st', P.SENTENCE_THEN_CAPITAL)} ELSE false END AND NOT ({R.imprint}) AND st <> '' AS ok
      FROM tv WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
    SELECT doc_id, min(pos) AS subtitle_pos FROM flagged WHERE NOT toc_yet AND ok AND pos > 1 GROUP BY doc_id""",
)
def subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line as title, second as author, contents headings as contents."""
    b = derived.book(spark, sf_dir)
    tag = (
        F.when(F.col("pos") == 0, "title").when(F.col("pos") == 1, "author")
        .when((F.col("type") == "heading") & T.is_toc_trigger(F.col("text")), "toc")
    )
    return S.pick_subtitle(b.withColumns({"structural_tag": tag, "action": F.lit("TRANSLATE")}))


def _some(pattern: str) -> str:
    return f"bool_or({duck.has('lower(text)', pattern)})"


@query(
    "A9",
    f"""WITH {derived.BOOK}, {R.text_view('book')},
    agg AS (SELECT doc_id, count(*) FILTER (type = 'heading' AND {R.chapter_like}) AS chapters,
        count(*) FILTER (type = 'list') AS lists, count(*) FILTER (type = 'paragraph') AS paras,
        {_some(duck.whole(rf"jee|neet|iit|nta|mock{P.S}*test|previous{P.S}+year|worksheet|homework"))}
          OR {_some(rf"^{P.S}*(?:q\d+[.)]{P.S}+|question{P.S}*\d+|\d+[.)]{P.S}+[^\n]+[?？]{P.S}*$)")}
          OR {_some(rf"(^|[^{P.WORD_CHARS}])exercise{P.S}*[:\-]{P.W}")} AS educational,
        {_some(rf"(?m)^abstract{P.S}*$")} OR bool_or(contains(' ' || lower(text) || ' ', ' abstract ')) AS abstract,
        {_some(rf"(?m)^(?:references|bibliography){P.S}*$")} AS refs, {_some(rf"(?m)^appendix{P.S}+[a-z0-9]")} AS appendix,
        {_some(duck.whole('table of contents|contents'))} AS contents
      FROM tv GROUP BY doc_id)
    SELECT doc_id, CASE
      WHEN educational THEN 'educational' WHEN abstract THEN 'article' WHEN refs AND paras > lists THEN 'article'
      WHEN chapters >= 3 THEN 'book' WHEN lists >= greatest(4, paras // 4) AND paras > 0 THEN 'notes'
      WHEN appendix THEN 'manual' WHEN contents AND chapters >= 2 THEN 'book' ELSE 'general' END AS document_type FROM agg""",
)
def doc_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.document_kind(derived.book(spark, sf_dir).withColumn("action", F.lit("TRANSLATE")))


_KINDS = (
    (duck.whole("gospel|corinthians|psalms?|qur'an|quran|vedas|torah"), "religious"),
    (duck.whole(rf"(?:biography|memoir){P.S}+of") + "|autobiograph", "biography"),
    (duck.whole("transcript"), "transcript"),
    (duck.whole("abstract|methodology|issn|peer-reviewed"), "article"),
    (duck.whole(rf"jee|neet|worksheet|lesson{P.S}*plan|course{P.S}+outline"), "educational"),
    (duck.whole(rf"self[- ]help|personal growth|seven{P.S}+habits|48{P.S}+laws"), "self_help"),
    (duck.whole(rf"epilogue|prologue|she{P.S}+said|he{P.S}+said"), "fiction"),
)
GENRE = f"""genre AS (SELECT doc_id, CASE {" ".join(f"WHEN {_some(p)} THEN '{k}'" for p, k in _KINDS)}
      WHEN count(*) FILTER (type = 'heading' AND {R.chapter_like}) >= 3 THEN 'book' ELSE 'general' END AS doc_kind
    FROM tv GROUP BY doc_id)"""


@query("A10", f"WITH {derived.BOOK}, {R.text_view('book')}, {GENRE} SELECT doc_id, doc_kind FROM genre")
def coarse_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.coarse_genre(derived.book(spark, sf_dir))


def _points(*steps: tuple[str, float]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}::DOUBLE" for c, v in steps) + " ELSE 0.0::DOUBLE END"


_wq = duck.words("sq")
_ur = duck.upper_ratio("sq")
CONFIDENCE = f"""{derived.BOOK}, {R.text_view('book')}, {GENRE},
feat AS (SELECT tv.*, doc_kind, {R.supports_heading} AS sup, {_wq} AS wc, {_ur} AS ur, ({R.chapter_like}) AS chap,
    type = 'paragraph' AND length(regexp_replace(text, '{P.S}+$', '')) > 24 AND NOT {duck.has('st', r'[.!?…\x{061f}]$')} AS open_tail,
    type = 'paragraph' AND {duck.has('st', r'^\p{Ll}')} AS low_start,
    NOT contains(sq, ' ') AND {R.in_list('lower(sq)', P.AMBIGUOUS_WORDS)} AS amb
  FROM tv JOIN genre USING (doc_id)),
near AS (SELECT *, coalesce(lead(sup) OVER w, false) AS nsup, coalesce(lead(wc) OVER w, 0) AS nwc,
    coalesce(lead(low_start) OVER w, false) AS nlow, coalesce(lag(open_tail) OVER w, false) AS popen
  FROM feat WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
typo AS (SELECT *, least(1.0, least(1.0, {_points(('ur >= 0.88', 0.38), ('ur >= 0.65', 0.12))}
      + {_points((f"wc <= 4 AND length(sq) <= 52 AND NOT {duck.has('sq', '[,;]$')}", 0.1))})
      + {_points(('nsup AND nwc >= 2', 0.12), ('nsup', 0.08))}) AS typ,
    {_points(('chap', 1.0),
             (duck.has('sq', duck.opens(r'(?:chapter|part|book|lesson|law|principle|narrative|unit|lecture|episode|module|segment|act) (?:\d+|[ivxlcdm]+)')), 0.95),
             (R.in_list('lower(sq)', P.FRONT_MATTER_LABELS), 0.82),
             (R.in_list('lower(sq)', P.ACADEMIC_LABELS) + " AND doc_kind IN ('educational', 'article')", 0.72),
             (R.in_list('lower(sq)', P.ACADEMIC_LABELS), 0.52),
             (R.in_list('lower(sq)', P.SUBHEADING_LABELS), 0.5),
             (duck.has('sq', duck.opens('scene|interlude|epilogue')), 0.76))} AS lex FROM near),
neg AS (SELECT *, least(1.0, {_points(('ur >= 0.88 AND wc >= 10', 0.4))} + {_points(('wc > 24', 0.45))}
      + {_points(('length(sq) > 180', 0.25))} + {_points((f"{duck.has('sq', P.MULTI_SENTENCE)} AND wc > 10", 0.55))}
      + {_points((duck.has('sq', '[,;]$'), 0.22))} + {_points(("contains(sq, ',') AND wc >= 8 AND NOT chap", 0.18))}
      + {_points(('amb AND NOT nsup AND typ < 0.34', 0.32), ('amb AND typ < 0.16', 0.12))}
      + {_points((duck.has('lower(sq)', r'^(?:the|a|an) [^ ]+$'), 0.26))}
      + {_points(('popen AND wc <= 4', 0.28))} + {_points(('nlow AND wc <= 3', 0.35))}) AS neg FROM typo),
conf AS (SELECT *, greatest(0.0, least(1.0, 0.22::DOUBLE + 0.5::DOUBLE * lex + 0.42::DOUBLE * typ - 0.5::DOUBLE * neg
      + {_points(('lex >= 0.95', 0.1))})) AS c0 FROM neg),
confidence AS (SELECT doc_id, pos, type, level, text, chap, amb,
    CASE WHEN {R.in_list('lower(sq)', P.SUBHEADING_LABELS)} AND nsup AND wc <= 4 THEN greatest(c0, 0.62::DOUBLE)
         ELSE c0 END AS confidence FROM conf WHERE st <> '')"""


@query("Q9 P24", f"WITH {CONFIDENCE} SELECT doc_id, pos, round(confidence, 6) AS confidence FROM confidence")
def heading_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = S.heading_confidence(derived.book(spark, sf_dir))
    return scored.filter(F.col("confidence").isNotNull()).select(
        "doc_id", "pos", F.round("confidence", 6).alias("confidence")
    )


@query(
    "Q9",
    f"""WITH {CONFIDENCE}, j AS (SELECT *, type = 'heading' AND NOT chap
        AND (confidence < 0.40 OR (confidence < 0.55 AND amb)) AS d FROM confidence)
    SELECT doc_id, pos, CASE WHEN d THEN 'paragraph' ELSE type END AS type,
           CASE WHEN d THEN 1 ELSE level END AS level FROM j""",
)
def refined_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = derived.book(spark, sf_dir)
    return S.refine_headings(b).filter(T.has_text(F.col("text"))).select("doc_id", "pos", "type", "level")


# three short lines in a row are planted from the turn number of each conversation
_PLANT = "CASE turn % 4 WHEN 0 THEN 'Law ' || conv_id WHEN 1 THEN 'Judgment' WHEN 2 THEN 'Interpretation' ELSE text END"


@query(
    "Q10",
    f"""WITH l AS (SELECT conv_id AS doc_id, turn AS pos, lower({_PLANT}) AS n FROM conversations),
    s AS (SELECT *, lead(n) OVER w AS n1, lead(n, 2) OVER w AS n2, lead(pos) OVER w AS p1, lead(pos, 2) OVER w AS p2
          FROM l WHERE {duck.words('n')} <= 4 WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
    SELECT DISTINCT doc_id, unnest([pos, p1, p2]) AS pos FROM s
    WHERE {duck.has('n', '^law [0-9]+$')} AND n1 = 'judgment' AND n2 = 'interpretation'""",
)
def three_line_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirework.sources import tables

    lines = tables.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"),
        F.lit("paragraph").alias("type"), F.expr(_PLANT).alias("text"),
    )
    return S.three_line_pattern(lines)


@query(
    "Q18 P23",
    f"""WITH {derived.BOOK}, a AS (SELECT doc_id, min(level) AS top, count(*) FILTER (level = 1) AS ones,
        count(*) FILTER (level = 2) AS twos FROM book WHERE type = 'heading' GROUP BY doc_id)
    SELECT doc_id, CASE WHEN top = 1 AND ones <= 1 AND twos > 0 THEN 2 ELSE top END AS chapter_level FROM a""",
)
def chapter_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chapter_start_level(derived.book(spark, sf_dir).filter(F.col("type") == "heading"))


@query(
    "Q2",
    f"""WITH {derived.BOOK},
    m AS (SELECT *, type = 'paragraph' AND coalesce(lag(type) OVER w, '') = 'paragraph' AS joins FROM book
          WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    i AS (SELECT *, sum((NOT joins)::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS isl FROM m),
    b AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, isl ORDER BY pos) - 1) // 3 AS bucket FROM i)
    SELECT doc_id, min(pos) AS pos, first(type ORDER BY pos) AS type,
           string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text
    FROM b GROUP BY doc_id, isl, bucket""",
)
def merge_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merge_adjacent(derived.book(spark, sf_dir)).select("doc_id", "pos", "type", "text")


def _runs_sql(source: str, link: str, glue: str) -> str:
    return f"""linked AS (SELECT *, coalesce({link}, false) AS joins FROM {source}
        WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    runs AS (SELECT *, sum((NOT joins)::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM linked)
    SELECT doc_id, min(pos) AS pos, first(type ORDER BY pos) AS type, {glue} AS text
    FROM runs GROUP BY doc_id, run"""


@query(
    "Q5 P25",
    f"""WITH {derived.BOOK}, {R.text_view('book')},
    paged AS (SELECT doc_id, pos, type, pos + 1 AS page, text, st, sq FROM tv),
    {_runs_sql('paged', f'''type = 'paragraph' AND lag(type = 'paragraph' AND NOT ({R.complete})) OVER w
       AND NOT ({R.leader_or_leaf}) AND NOT lag({R.leader_or_leaf}) OVER w''',
       f"CASE WHEN count(*) = 1 THEN first(text) ELSE replace(regexp_replace(string_agg(sq, chr(30) ORDER BY pos), ' ?-' || chr(30), '', 'g'), chr(30), ' ') END")}""",
)
def stitched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block per page, so every open paragraph meets a page break."""
    b = derived.book(spark, sf_dir).withColumn("source_page", F.col("pos") + 1)
    return M.stitch_pages(b).select("doc_id", "pos", "type", "text")


@query(
    "Q16 P5 P6",
    f"""WITH {ACTIONS},
    flagged AS (SELECT *, (action = 'TRANSLATE' AND type = 'paragraph' AND st <> '' AND structural_tag IS NULL) AS body,
       ({R.section_label}) AS label, ({R.complete}) AS closed, ({R.continuation}) AS cont FROM classified),
    {_runs_sql('flagged', '''body AND lag(body) OVER w AND NOT label AND NOT lag(label) OVER w
       AND (NOT lag(closed) OVER w OR cont)''',
       "CASE WHEN first(body ORDER BY pos) THEN string_agg(st, ' ' ORDER BY pos) ELSE first(text ORDER BY pos) END")}""",
)
def merged_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merge_shards(classified_regions(spark, sf_dir, *MK.SHARDS)).select("doc_id", "pos", "type", "text")


@query(
    "Q4 P24",
    f"""WITH {derived.BOOK}, {R.text_view('book')},
    s AS (SELECT *, type = 'heading' AND ({R.caps_emphasis}) AS shout,
            type = 'paragraph' AND length(st) >= 12 AND NOT ends_with(st, '.') AS opens FROM tv),
    g AS (SELECT *, sum((NOT shout)::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM s),
    h AS (SELECT *, coalesce(shout AND first_value(opens) OVER w AND bool_and(source_page = p0) OVER w, false) AS joins
          FROM (SELECT *, first_value(source_page) OVER (PARTITION BY doc_id, grp ORDER BY pos) AS p0 FROM g)
          WINDOW w AS (PARTITION BY doc_id, grp ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    runs AS (SELECT *, sum((NOT joins)::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM h)
    SELECT doc_id, min(pos) AS pos, CASE WHEN count(*) = 1 THEN first(text ORDER BY pos)
           ELSE string_agg(st, ' ' ORDER BY pos) END AS text FROM runs GROUP BY doc_id, run""",
)
def folded_emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.fold_caps_emphasis(derived.book(spark, sf_dir)).select("doc_id", "pos", "text")


@query(
    "Q21",
    f"""WITH t AS (SELECT conv_id AS doc_id, turn AS pos, CASE WHEN turn % 3 = 1 THEN 'Same  line.' ELSE
          CASE WHEN turn % 3 = 2 THEN 'Same line. ' ELSE text END END AS text FROM conversations),
    n AS (SELECT *, {duck.squash('text')} AS norm FROM t)
    SELECT doc_id, pos FROM n QUALIFY lag(norm) OVER (PARTITION BY doc_id ORDER BY pos) IS DISTINCT FROM norm""",
)
def consecutive_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirework.sources import tables

    lines = tables.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.lit("paragraph").alias("type"),
        F.when(F.col("turn") % 3 == 1, "Same  line.").when(F.col("turn") % 3 == 2, "Same line. ")
        .otherwise(F.col("text")).alias("text"),
    )
    return M.drop_consecutive_duplicates(lines).select("doc_id", "pos")
