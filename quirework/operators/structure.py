"""Document structure: contents regions, titles, heading confidence, outline.

Each rule is a set of native flags plus window arithmetic. The contents region, a
two-state machine, is solved without a loop: a row either fixes the state, keeps it
or flips it, so the state is the last fixed value changed by the parity of flips since.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quirework.functions import patterns as P
from quirework.functions import text as T
from quirework.operators import marks as MK
from quirework.operators.merging import by_doc


def _upto() -> WindowSpec:
    return by_doc().rowsBetween(Window.unboundedPreceding, 0)

_FRONT = ("title", "author", "toc")


def _count_upto(flag: Column) -> Column:
    return F.sum(flag.cast("int")).over(_upto())


def contents_region(blocks: DataFrame) -> DataFrame:
    """Q7, first half: adds ``_toc`` for rows inside or opening a contents region."""
    rows = MK.marked(blocks, *MK.REGION)
    has, filled = MK.has, MK.has("filled")
    heading = filled & (F.col("type") == "heading")
    prose = filled & F.col("type").isin("paragraph", "list")
    table = F.col("type") == "table"
    label = has("label") | ((F.col("type") == "paragraph") & has("starts"))
    flagged = rows.withColumns({
        "_imprint": prose & has("imprint"),
        "_blob": filled & has("blob"),
        "_opens": (heading & has("trigger")) | (prose & label),
        "_keeps": table | (heading & (has("trigger") | has("row_in_contents")))
        | (prose & ~has("blob") & ~has("runs_on") & has("listing")),
    })
    keeps = F.col("_keeps") & ~F.col("_imprint")
    stepped = flagged.withColumns({
        "_if_open": keeps,
        "_tag_open": keeps | (prose & F.col("_blob") & ~F.col("_imprint")),
    }).withColumns({
        "_fixed": F.when(F.col("_if_open") == F.col("_opens"), F.col("_opens").cast("int")),
        "_flips": _count_upto(F.col("_opens") & ~F.col("_if_open")),
    })
    anchor = F.last(
        F.when(F.col("_fixed").isNotNull(), F.struct(F.col("_fixed").alias("v"), F.col("_flips").alias("f"))),
        ignorenulls=True,
    ).over(_upto())
    after = stepped.withColumn("_anchor", anchor).withColumn(
        "_after",
        (F.coalesce(F.col("_anchor.v"), F.lit(0)) + F.col("_flips")
         - F.coalesce(F.col("_anchor.f"), F.lit(0))) % 2,
    )
    inside = F.coalesce(F.lag("_after").over(by_doc()), F.lit(0)) == 1
    tagged = F.when(inside, F.col("_tag_open")).otherwise(F.col("_opens"))
    swept = F.col("_blob") & F.col("type").isin("paragraph", "heading")
    return after.withColumn("_toc", tagged | swept).select(*blocks.columns, "_toc")


def orphan_contents_runs(blocks: DataFrame, toc: str = "_toc") -> DataFrame:
    """Q8: printed contents pages without a heading join the contents flag.

    A run is a stretch of leader and listing rows from its first leader row on, plus
    a contents label right before it; it counts with 2+ leader rows and 3+ rows.
    """
    rows = MK.marked(blocks, *MK.ORPHANS)
    eligible = F.col("type").isin("paragraph", "heading") & MK.has("visible")
    leader = eligible & MK.has("leader")
    listing = eligible & MK.has("listed")
    flagged = rows.withColumns({
        "_leader": leader,
        "_member": leader | listing,
        "_label": eligible & MK.has("trigger") & ~leader,
    }).withColumn("_stretch", _count_upto(~F.col("_member")))
    stretch = Window.partitionBy("doc_id", "_stretch").orderBy("pos")
    opened = flagged.withColumn(
        "_leaders_upto", F.sum(F.col("_leader").cast("int")).over(stretch)
    ).withColumn("_in_run", F.col("_member") & (F.col("_leaders_upto") >= 1))
    first = F.col("_leader") & (F.col("_leaders_upto") == 1)
    labelled = opened.withColumn(
        "_labelled", first & F.coalesce(F.lag("_label").over(by_doc()), F.lit(False))
    )
    whole = Window.partitionBy("doc_id", "_stretch")
    size = F.sum((F.col("_in_run") | F.col("_labelled")).cast("int")).over(whole)
    good = (
        (F.sum(F.col("_leader").cast("int")).over(whole) >= 2)
        & (size + F.max(F.col("_labelled").cast("int")).over(whole) >= 3)
    )
    scored = labelled.withColumn("_hit", F.col("_in_run") & good)
    before_hit = F.col("_label") & F.coalesce(
        F.lead(F.col("_hit") & F.col("_labelled")).over(by_doc()), F.lit(False)
    )
    return scored.withColumn(toc, F.col(toc) | F.col("_hit") | before_hit).select(*blocks.columns)


def tag_book_structure(blocks: DataFrame) -> DataFrame:
    """Q7 + Q8: ``structural_tag`` becomes toc, title, author or null."""
    rows = orphan_contents_runs(contents_region(MK.marked(blocks, *MK.REGION, *MK.ORPHANS, *MK.TITLES)))
    prose = F.col("type").isin("paragraph", "list")
    ranked = rows.withColumns({
        "_rn": F.row_number().over(by_doc()),
        "_seen_toc": F.max(F.col("_toc").cast("int")).over(_upto()),
        "_title_like": (
            (F.col("type") == "heading") & (F.col("level") == 1) & ~MK.has("milestone")
        ) | (prose & MK.has("words_15")),
        "_author_like": prose & MK.has("filled") & MK.has("words_25"),
    })
    title = (F.col("_rn") == 1) & (F.col("_seen_toc") == 0) & F.col("_title_like")
    with_title = ranked.withColumn("_title", title)
    candidate = F.col("_author_like") & (F.col("_seen_toc") == 0)
    broken = _count_upto(~(candidate | F.col("_title")))
    run = with_title.withColumn("_broken", broken).withColumn(
        "_nth", F.col("_rn") - F.max(F.col("_title").cast("int")).over(_upto())
    )
    tag = (
        F.when(F.col("_toc"), "toc")
        .when(F.col("_title"), "title")
        .when(candidate & (F.col("_broken") == 0) & (F.col("_nth") <= 4), "author")
    )
    return run.withColumn("structural_tag", tag).select(*dict.fromkeys([*blocks.columns, "structural_tag"]))


# --- heading confidence ----------------------------------------------------

# (pattern, genre, literals that every match holds one of) in order of precedence; matched on the lower-cased texts (fixed values)
_GENRES = (
    (P.whole("gospel|corinthians|psalms?|qur'an|quran|vedas|torah"), "religious",
     ("gospel", "corinthians", "psalm", "qur'an", "quran", "vedas", "torah")),
    (P.whole(rf"(?:biography|memoir){P.S}+of") + "|autobiograph", "biography", ("biograph", "memoir")),
    (P.whole("transcript") + rf"|{P.NOT_AFTER_WORD}(?:speaker|moderator){P.S}*:(?={P.W})", "transcript",
     ("transcript", "speaker", "moderator")),
    (P.whole("abstract|methodology|issn|peer-reviewed") + rf"|{P.NOT_AFTER_WORD}doi:(?={P.W})", "article",
     ("abstract", "methodology", "issn", "peer-reviewed", "doi:")),
    (P.whole(rf"jee|neet|worksheet|lesson{P.S}*plan|course{P.S}+outline"), "educational",
     ("jee", "neet", "worksheet", "lesson", "course")),
    (P.whole(rf"self[- ]help|personal growth|seven{P.S}+habits|48{P.S}+laws"), "self_help",
     ("help", "personal growth", "habits", "laws")),
    (P.whole(rf"epilogue|prologue|she{P.S}+said|he{P.S}+said"), "fiction", ("epilogue", "prologue", "said")),
)


def _any_row(rows: Column, pattern: str, *needed: str) -> Column:
    """Whether a lower-cased text of the document's ``rows`` matches; the pattern runs only where one of the literals occurs, if any are given."""
    low = F.lower("text")
    hit = low.rlike(pattern)
    if needed:
        hit = F.when(T.holds(low, *needed), hit)
    return F.coalesce(F.bool_or(rows & hit), F.lit(False))


def coarse_genre(blocks: DataFrame) -> DataFrame:
    """A10: genre hint per document: the first pattern that any of its texts has, else by its chapters."""
    rows = (F.coalesce(F.col("text"), F.lit("")) != "") & (F.col("type") != "table")
    flags = {f"g{i}": _any_row(rows, pattern, *needed) for i, (pattern, _, needed) in enumerate(_GENRES)}
    chapters = F.count_if((F.col("type") == "heading") & T.is_chapter_like(F.col("text")))
    seen = blocks.groupBy("doc_id").agg(*[v.alias(k) for k, v in flags.items()], chapters.alias("chapters"))
    kind = F.when(F.col("g0"), _GENRES[0][1])
    for i, (_, name, _) in enumerate(_GENRES[1:], 1):
        kind = kind.when(F.col(f"g{i}"), name)
    return seen.select("doc_id", kind.when(F.col("chapters") >= 3, "book").otherwise("general").alias("doc_kind"))


def three_line_pattern(blocks: DataFrame) -> DataFrame:
    """Q10: positions in "law n / judgment / interpretation" runs of short lines."""
    text = F.col("text")
    short = blocks.filter(
        (F.col("type") != "table") & (F.coalesce(text, F.lit("")) != "") & (T.word_count(text) <= 4)
    ).select("doc_id", "pos", T.normalized(text).alias("n"))
    ahead = short.withColumns({
        "n1": F.lead("n", 1).over(by_doc()), "n2": F.lead("n", 2).over(by_doc()),
        "p1": F.lead("pos", 1).over(by_doc()), "p2": F.lead("pos", 2).over(by_doc()),
    })
    hits = ahead.filter(
        F.col("n").rlike(r"^law \d+$") & (F.col("n1") == "judgment") & (F.col("n2") == "interpretation")
    )
    return hits.select("doc_id", F.explode(F.array("pos", "p1", "p2")).alias("pos")).distinct()


def heading_confidence(blocks: DataFrame, genre: DataFrame | None = None) -> DataFrame:
    """Q9: adds ``confidence`` (null for tables, tagged and blank blocks).

    Reads only the rows as they arrive (previous and next row by window), which is
    why the demotion that follows needs no pass order.
    """
    genre = coarse_genre(blocks) if genre is None else genre
    boosted = three_line_pattern(blocks).withColumn("_boost", F.lit(True))
    rows = blocks.join(genre, "doc_id", "left").join(boosted, ["doc_id", "pos"], "left")
    rows, x = T.Line.prepare(rows)
    text, wc = F.col("text"), F.col("_words")
    rows = rows.withColumns({
        "_supports": T.supports_heading(x),
        "_chapter": T.is_chapter_like(x),
        "_upper": T.upper_ratio(x.sq),
        "_open_tail": (F.col("type") == "paragraph") & (F.length(T.rstrip(text)) > 24)
        & ~x.st.rlike(r"[.!?…\x{061f}]$"),
        "_low_start": (F.col("type") == "paragraph") & x.st.rlike(r"^\p{Ll}"),
    })
    rows = rows.withColumns({
        "_next_supports": F.coalesce(F.lead("_supports").over(by_doc()), F.lit(False)),
        "_next_words": F.coalesce(F.lead("_words").over(by_doc()), F.lit(0)),
        "_next_low": F.coalesce(F.lead("_low_start").over(by_doc()), F.lit(False)),
        "_prev_open": F.coalesce(F.lag("_open_tail").over(by_doc()), F.lit(False)),
    })
    low, n, ur = x.low, x.nq, F.col("_upper")
    chapter, kind = F.col("_chapter"), F.col("doc_kind")
    numbered = x.sq.rlike(P.opens(
        r"(?:chapter|part|book|lesson|law|principle|narrative|unit|lecture|episode|module|segment|act)"
        r" (?:\d+|[ivxlcdm]+)"
    )) | x.sq.rlike(rf"(?i)^section \d{{1,3}}{P.NOT_BEFORE_WORD}(?!\.\d)")
    lexical = (
        F.when(chapter, 1.0)
        .when(numbered, 0.95)
        .when(low.isin(*P.FRONT_MATTER_LABELS), 0.82)
        .when(low.isin(*P.ACADEMIC_LABELS),
              F.when(kind.isin("educational", "article"), 0.72).otherwise(0.52))
        .when(low.isin(*P.SUBHEADING_LABELS), 0.5)
        .when(x.sq.rlike(P.opens("scene|interlude|epilogue")), 0.76)
        .otherwise(0.0)
    )

    def bonus(*steps: tuple[Column, float]) -> Column:
        out = F.when(steps[0][0], steps[0][1])
        for cond, value in steps[1:]:
            out = out.when(cond, value)
        return out.otherwise(0.0)

    score = bonus((ur >= 0.88, 0.38), (ur >= 0.65, 0.12))
    if "pdf_hints" in blocks.columns:
        h = F.col("pdf_hints")
        delta = F.when(h["font_pt_max"] > 0, h["font_pt_max"] - h["body_font_pt"])
        score = (
            score
            + bonus((delta >= 7.0, 0.32), (delta >= 3.25, 0.22), (delta >= 1.5, 0.08))
            + bonus((h["bold_fraction"] >= 0.88, 0.18), (h["bold_fraction"] >= 0.72, 0.12))
            + bonus((h["gap_before_pt"] >= 14.0, 0.14), (h["gap_before_pt"] >= 8.0, 0.08))
            + bonus(((h["lines_merged"] == 1) & (wc <= 12), 0.06))
        )
    score = score + bonus(((wc <= 4) & (n <= 52) & ~x.sq.rlike("[,;]$"), 0.1))
    follow = bonus((F.col("_next_supports") & (F.col("_next_words") >= 2), 0.12),
                   (F.col("_next_supports"), 0.08))
    rows = rows.withColumn("_typ", F.least(F.lit(1.0), F.least(score, F.lit(1.0)) + follow))
    typ = F.col("_typ")
    one_word = ~x.sq.contains(" ") & low.isin(*P.AMBIGUOUS_WORDS)
    penalty = (
        bonus(((ur >= 0.88) & (wc >= 10), 0.4))
        + bonus((wc > 24, 0.45))
        + bonus((n > 180, 0.25))
        + bonus((x.sq.rlike(P.MULTI_SENTENCE) & (wc > 10), 0.55))
        + bonus((x.sq.rlike("[,;]$"), 0.22))
        + bonus((x.sq.contains(",") & (wc >= 8) & ~chapter, 0.18))
        + bonus((one_word & ~F.col("_next_supports") & (typ < 0.34), 0.32),
                (one_word & (typ < 0.16), 0.12))
        + bonus((low.rlike(r"^(?:the|a|an) [^ ]+$"), 0.26))
        + bonus((F.col("_prev_open") & (wc <= 4), 0.28))
        + bonus((F.col("_next_low") & (wc <= 3), 0.35))
    )
    rows = rows.withColumns({"_lex": lexical, "_neg": F.least(penalty, F.lit(1.0))})
    raw = 0.22 + 0.5 * F.col("_lex") + 0.42 * typ - 0.5 * F.col("_neg") + bonus((F.col("_lex") >= 0.95, 0.1))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    lifted = F.when(F.col("_boost"), F.least(F.lit(1.0), clamped + 0.12)).otherwise(clamped)
    labelled = low.isin(*P.SUBHEADING_LABELS) & F.col("_next_supports") & (wc <= 4)
    conf = F.when(labelled, F.greatest(lifted, F.lit(0.62))).otherwise(lifted)
    protected = (F.col("type") == "table") | (x.st == "")
    if "structural_tag" in blocks.columns:
        protected = protected | F.coalesce(F.col("structural_tag").isin(*_FRONT), F.lit(False))
    return rows.withColumns({
        "confidence": F.when(~protected, conf),
        "_ambiguous": one_word,
    }).select(*blocks.columns, "confidence", F.col("_ambiguous"), F.col("_chapter"))


def refine_headings(blocks: DataFrame, genre: DataFrame | None = None) -> DataFrame:
    """Q9: demote spurious headings to paragraphs; nothing is ever promoted."""
    scored = heading_confidence(blocks, genre)
    demote = (
        (F.col("type") == "heading") & ~F.col("_chapter")
        & ((F.col("confidence") < 0.40) | ((F.col("confidence") < 0.55) & F.col("_ambiguous")))
    )
    demote = F.coalesce(demote, F.lit(False))
    return scored.withColumn("_demote", demote).withColumns({
        "type": F.when(F.col("_demote"), "paragraph").otherwise(F.col("type")),
        "level": F.when(F.col("_demote"), 1).otherwise(F.col("level")),
        "text": F.when(F.col("_demote"), T.squash(F.col("text"))).otherwise(F.col("text")),
    }).select(*blocks.columns)


# --- semantic enrichment ---------------------------------------------------


def demote_false_headings(classified: DataFrame) -> DataFrame:
    """Q13: long, multi-sentence or clause-like headings become paragraphs."""
    rows = MK.marked(classified, *MK.HEADINGS)
    live = F.col("action") == "TRANSLATE"
    backed = F.coalesce(F.lead(live & MK.has("supports")).over(by_doc()), F.lit(False)) & MK.has("ambiguous")
    candidate = (
        live & (F.col("type") == "heading") & MK.has("visible")
        & ~F.coalesce(F.col("structural_tag").isin(*_FRONT), F.lit(False))
    )
    marked = rows.withColumn("_false", candidate & ~backed & MK.has("no_heading"))
    return marked.withColumns({
        "type": F.when(F.col("_false"), "paragraph").otherwise(F.col("type")),
        "level": F.when(F.col("_false"), 1).otherwise(F.col("level")),
        "semantic_role": F.when(F.col("_false"), "paragraph"),
    }).select(*dict.fromkeys([*classified.columns, "semantic_role"]))


def _with_subtitle(classified: DataFrame) -> DataFrame:
    """Q14: adds ``subtitle_pos``, the position of the document's subtitle block or null."""
    rows = MK.marked(classified, *MK.SUBTITLES)
    tag = F.coalesce("structural_tag", F.lit(""))
    live = F.col("action") != "OMIT"
    qualifies = ~MK.has("imprint") & MK.has("visible") & (
        ((F.col("type") == "heading") & MK.has("short_title")) | ((F.col("type") == "paragraph") & MK.has("short_line"))
    )
    flagged = rows.withColumns({
        "_toc_yet": F.max((tag == "toc").cast("int")).over(_upto()),
        "_title_yet": F.max((live & (tag == "title")).cast("int")).over(_upto()),
        "_ok": live & ~tag.isin("title", "author") & qualifies,
    })
    hit = (F.col("_toc_yet") == 0) & (F.col("_title_yet") == 1) & F.col("_ok")
    return flagged.withColumn(
        "subtitle_pos", F.min(F.when(hit, F.col("pos"))).over(Window.partitionBy("doc_id"))
    ).select(*classified.columns, "subtitle_pos")


def pick_subtitle(classified: DataFrame) -> DataFrame:
    """Q14: one row per document that has a subtitle."""
    return _with_subtitle(classified).filter(F.col("pos") == F.col("subtitle_pos")).select("doc_id", "subtitle_pos")


def outline(classified: DataFrame) -> DataFrame:
    """Q15: chapter = 1, heading = 2, subheading = 3.

    A heading becomes a subheading when the last row that counts was a non-chapter
    heading itself, so only the kind of the previous counting row is needed.
    """
    rows = MK.marked(classified, *MK.OUTLINE)
    role = F.coalesce("semantic_role", F.lit(""))
    tag = F.coalesce("structural_tag", F.lit(""))
    heading = (F.col("type") == "heading") & MK.has("visible")
    kind = (
        F.when(F.col("action") == "OMIT", F.lit(None))
        .when(role.isin("subtitle", "document_title", "author"), "body")
        .when(tag.isin(*_FRONT), F.lit(None))
        .when(heading & MK.has("chapter"), "chapter")
        .when(heading, "heading")
        .when(F.col("type").isin("paragraph", "list", "table"), "body")
    )
    marked = rows.withColumn("_kind", kind)
    before = F.last("_kind", ignorenulls=True).over(by_doc().rowsBetween(Window.unboundedPreceding, -1))
    placed = marked.withColumn("_before", before)
    final = (
        F.when(F.col("_kind") == "chapter", "chapter")
        .when((F.col("_kind") == "heading") & (F.col("_before") == "heading"), "subheading")
        .when(F.col("_kind") == "heading", "heading")
        .otherwise(F.col("semantic_role"))
    )
    level = (
        F.when(F.col("_kind") == "chapter", 1)
        .when((F.col("_kind") == "heading") & (F.col("_before") == "heading"), 3)
        .when(F.col("_kind") == "heading", 2)
        .otherwise(F.col("level"))
    )
    return placed.withColumns({
        "semantic_role": final, "level": level,
    }).select(*classified.columns)


def document_kind(classified: DataFrame) -> DataFrame:
    """Document kind from all texts that are not omitted, as flags and counts in one aggregate."""
    def some(name: str) -> Column:
        return F.coalesce(F.bool_or(MK.has("filled") & MK.has(name)), F.lit(False)).alias(name)

    rows = MK.marked(classified.filter(F.col("action") != "OMIT"), *MK.KINDS)
    seen = rows.groupBy("doc_id").agg(
        *[some(name) for name in ("educational", "abstract", "references", "appendix", "contents")],
        F.count_if((F.col("type") == "heading") & MK.has("chapter")).alias("chapters"),
        F.count_if(F.col("type") == "list").alias("lists"),
        F.count_if(F.col("type") == "paragraph").alias("paras"),
    )
    lists, paras, chapters = F.col("lists"), F.col("paras"), F.col("chapters")
    kind = (
        F.when(F.col("educational"), "educational")
        .when(F.col("abstract") | (F.col("references") & (paras > lists)), "article")
        .when(chapters >= 3, "book")
        .when((lists >= F.greatest(F.lit(4), F.floor(paras / 4))) & (paras > 0), "notes")
        .when(F.col("appendix"), "manual")
        .when(F.col("contents") & (chapters >= 2), "book")
        .otherwise("general")
    )
    return seen.select("doc_id", kind.alias("document_type"))


def enrich(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roles and outline levels per block, and one metadata row per document."""
    kind, columns = document_kind(classified), classified.columns
    classified = MK.marked(classified, *MK.HEADINGS, *MK.SUBTITLES, *MK.OUTLINE, "spoken")
    demoted = _with_subtitle(demote_false_headings(classified))
    tag = F.coalesce("structural_tag", F.lit(""))
    roles = demoted.withColumn(
        "semantic_role",
        F.when((tag == "title") & (F.col("type") != "table"), "document_title")
        .when((tag == "author") & (F.col("type") != "table"), "author")
        .when((F.col("pos") == F.col("subtitle_pos")) & (F.col("action") == "TRANSLATE"), "subtitle")
        .otherwise(F.col("semantic_role")),
    )
    lined = outline(roles)
    quoted = (
        (F.col("action") == "TRANSLATE") & (F.col("type") == "paragraph")
        & F.col("semantic_role").isNull() & MK.has("spoken")
    )
    out = lined.withColumn(
        "semantic_role", F.when(quoted, "quote").otherwise(F.col("semantic_role"))
    )
    subtitle = out.groupBy("doc_id").agg(F.first("subtitle_pos").alias("subtitle_pos"))
    chapters = (
        out.filter((F.col("semantic_role") == "chapter") & (F.col("action") != "OMIT"))
        .groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", T.strip(F.col("text")).alias("t")))).alias("c"))
        .select("doc_id", F.col("c.t").alias("chapter_titles"))
    )
    meta = subtitle.join(kind, "doc_id", "left").join(chapters, "doc_id", "left")
    return out.select(*dict.fromkeys([*columns, "semantic_role"])), meta.select(
        "doc_id",
        F.coalesce("document_type", F.lit("general")).alias("document_type"),
        "subtitle_pos",
        F.coalesce("chapter_titles", F.array().cast("array<string>")).alias("chapter_titles"),
    )


def _chapter_level(top: Column, ones: Column, twos: Column) -> Column:
    return F.when((top == 1) & (ones <= 1) & (twos > 0), 2).otherwise(top)


def chapter_start_level(headings: DataFrame) -> DataFrame:
    """Q18: outline level at which a document's chapters start."""
    level = F.col("level")
    return headings.groupBy("doc_id").agg(_chapter_level(
        F.min(level), F.count_if(level == 1), F.count_if(level == 2)).alias("chapter_level"))


def with_chapter_level(rows: DataFrame, is_heading: Column) -> DataFrame:
    """Q18 as a window, for rows already partitioned by document."""
    doc = Window.partitionBy("doc_id")
    level = F.when(is_heading, F.col("level"))
    return rows.withColumn("chapter_level", _chapter_level(
        F.min(level).over(doc), F.count_if(level == 1).over(doc), F.count_if(level == 2).over(doc)))
