from __future__ import annotations

import re

from conftest import SF_DIR, column
from pyspark.sql import functions as F

from quirework.functions import patterns as P
from quirework.functions import text as T
from quirework.operators import classify as CL
from quirework.operators import structure as S
from quirework.plans import derived


def _h(text, level=1, **kw):
    return {"type": "heading", "text": text, "level": level, **kw}


def _p(text, **kw):
    return {"text": text, **kw}


def test_region_closes_at_body_and_keeps_rows(blocks):
    df = blocks([
        _h("Contents"), _p("Preface ... vii"), _h("CHAPTER 1.5 ........... 35", 2),
        _p("Preface I started working at an agency in August 2001. A few weeks later, the world changed."),
    ])
    assert column(S.tag_book_structure(df), "structural_tag") == ["toc", "toc", "toc", None]


def test_imprint_inside_contents_is_no_entry(blocks):
    df = blocks([_h("Contents"), _p("THE MACMILLAN COMPANY"), _p("FROM THE RUSSIAN BY SOMEBODY")])
    assert column(S.tag_book_structure(df), "structural_tag") == ["toc", None, None]


def test_orphan_leader_rows_are_contents(blocks):
    df = blocks([
        _p("PART 1 .................. 14"), _p("CHAPTER 1.1 Bad thoughts ........ 16"), _p("CHAPTER 1.2 Default ....... 22"),
        _p("Preface I started working at an agency in 2001 and the world changed."),
    ])
    assert column(S.tag_book_structure(df), "structural_tag") == ["toc", "toc", "toc", None]


def test_title_and_author_lines(blocks):
    df = blocks([_h("My Novel"), _p("A. Writer"), _p("B. Writer"), _h("Contents"), _p("One ..... 1")])
    assert column(S.tag_book_structure(df), "structural_tag") == ["title", "author", "author", "toc", "toc"]


def _sequential_regions(rows):
    """The region rule row by row, over native flags."""
    open_, out = False, []
    for r in rows:
        if open_:
            out.append(r.if_open_tag)
            open_ = r.if_open
        else:
            out.append(r.opens)
            open_ = r.opens
    return out


def test_region_windows_equal_the_row_by_row_rule(spark):
    b, x = T.Line.prepare(derived.book(spark, SF_DIR))
    prose, heading = F.col("type").isin("paragraph", "list"), F.col("type") == "heading"
    label = ((x.n < 120) & T.is_toc_standalone(x) & ~x.st.rlike(P.SENTENCE_THEN_CAPITAL)) | T.starts_contents_region(x)
    imprint, blob = T.is_imprint(x), T.is_merged_toc_blob(x)
    keeps = (heading & (T.is_toc_trigger(x) | T.is_toc_row_in_contents(x))) | (
        prose & ~imprint & ~blob & (x.words < 40) & (x.n < 320) & ~T.is_toc_body_opener(x) & T.is_toc_listing_row(x))
    flags = b.select(
        "doc_id", "pos", ((heading & T.is_toc_trigger(x)) | (prose & label)).alias("opens"), keeps.alias("if_open"),
        (keeps | (prose & blob & ~imprint)).alias("if_open_tag"), (blob & (prose | heading) & (F.col("type") != "list")).alias("sweep"),
    ).orderBy("doc_id", "pos").collect()
    got = S.contents_region(derived.book(spark, SF_DIR)).orderBy("doc_id", "pos").collect()
    by_doc: dict = {}
    for r in flags:
        by_doc.setdefault(r.doc_id, []).append(r)
    want = [t or r.sweep for rows in by_doc.values() for t, r in zip(_sequential_regions(rows), rows, strict=True)]
    assert [r["_toc"] for r in got] == want and any(want)


def test_orphan_runs_equal_greedy_scan(spark):
    b = derived.book(spark, SF_DIR).withColumn("text", F.expr(
        "case (doc_id * 7 + pos * pos) % 5 when 0 then 'Row .... 12' when 1 then 'Entry 14' when 2 then 'Contents' "
        "when 3 then 'Other ..... ix' else text end")).withColumn("_toc", F.lit(False))
    rows, x = T.Line.prepare(b)
    eligible = F.col("type").isin("paragraph", "heading")
    flags = rows.select(
        "doc_id", "pos", (eligible & T.is_toc_leader_row(x)).alias("leader"), (eligible & T.is_toc_trigger(x)).alias("label"),
        (eligible & T.is_toc_listing_row(x) & (x.st.rlike(P.TRAILING_ARABIC) | x.st.rlike(P.DOT_LEADER))).alias("listing"),
    ).orderBy("doc_id", "pos").collect()
    docs: dict = {}
    for r in flags:
        docs.setdefault(r.doc_id, []).append(r)
    want = set()
    for doc, rs in docs.items():
        i = 0
        while i < len(rs):
            run, leaders, j = [], 0, i
            while j < len(rs):
                if rs[j].leader:
                    leaders += 1
                elif not (rs[j].label and not run) and not (leaders and rs[j].listing):
                    break
                run.append(j)
                j += 1
            if leaders >= 2 and len(run) >= 3:
                want |= {(doc, rs[k].pos) for k in run}
                i = run[-1] + 1
            else:
                i += 1
    got = {(r.doc_id, r.pos) for r in S.orphan_contents_runs(b).filter("_toc").collect()}
    assert got == want and want


def test_back_matter_regions(blocks):
    df = blocks([
        _h("Notes", 2), _p("hidden"), _h("Body Again", 2), _h("Index", 2), _p("alpha … 1"), _h("Epilogue", 1), _p("Visible."),
        _h("Acknowledgments", 2), _p("Thanks to everyone."),
    ])
    assert column(CL.classify(df.drop("action")), "action") == [
        "OMIT", "OMIT", "TRANSLATE", "OMIT", "OMIT", "TRANSLATE", "TRANSLATE", "TRANSLATE", "TRANSLATE"]


def test_part_inventory_page(blocks):
    rows = [
        _h("1"), _h("Part 1. The Enemies of Thought"),
        {"type": "list", "text": "1. 1.1 A\n2. 1.2 B\n3. 1.3 C", "list_kind": "ordered"}, _h("Preface", 2), _p("Body text."),
    ]
    assert column(CL.classify(blocks(rows).drop("action")), "action") == ["OMIT"] * 3 + ["TRANSLATE"] * 2
    short = [_h("Part 9. Short"), _p("9.1 One\n9.2 Two"), _p("Real body starts.")]
    assert column(CL.classify(blocks(short).drop("action")), "action") == ["TRANSLATE"] * 3


def test_part_inventory_equals_greedy_scan(spark):
    texts = {0: "Part 1. Start", 1: "1.1 a 1.2 b", 2: "1.3 c", 3: "12.", 4: "2.1 other", 5: "plain words", 6: "Part 2. Next"}
    b = derived.lines(spark, SF_DIR).withColumn("k", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(7)).cast("int"))
    pick = F.element_at(F.array(*[F.lit(t) for t in texts.values()]), F.col("k") + 1)
    b = b.withColumns({"text": pick, "type": F.lit("paragraph"), "structural_tag": F.lit(None).cast("string")}).drop("k")
    docs: dict = {}
    for r in b.orderBy("doc_id", "pos").collect():
        docs.setdefault(r.doc_id, []).append(r)
    want = set()
    for doc, rs in docs.items():
        i = 0
        while i < len(rs):
            m = re.match(r"Part (\d+)", rs[i].text)
            j, hits = i + 1, 0
            while m and j < len(rs):
                subs = re.findall(r"(\d+)\.\d+", rs[j].text)
                if subs and all(s == m.group(1) for s in subs):
                    hits += len(subs)
                elif subs or not re.match(r"^\d{1,2}\.$", rs[j].text):
                    break
                j += 1
            if hits >= 3:
                want |= {(doc, r.pos) for r in rs[i:j]}
                i = j
            else:
                i += 1
    got = {(r.doc_id, r.pos) for r in CL.part_inventory(b).collect()}
    assert got == want and want


def test_part_inventory_is_of_rows_not_of_positions(blocks):
    """A table far behind the last line ends an inventory; only rows belong to it, whatever lies between their positions."""
    rows = [_h("1", pos=3), _h("Part 1. The Enemies of Thought", pos=70), _p("1.1 A 1.2 B", pos=900), _p("1.3 C", pos=5_000), {"type": "table", "pos": 1_000_000}]
    far = [{**r, "doc_id": 2} for r in rows[:-1]] + [{"type": "table", "pos": 1_000_000_000, "doc_id": 2}]
    got = sorted((r.doc_id, r.pos) for r in CL.part_inventory(blocks(rows)).collect())
    assert got == [(1, p) for p in (3, 70, 900, 5_000, 1_000_000)]
    assert sorted(r.pos for r in CL.part_inventory(blocks(far)).collect()) == [3, 70, 900, 5_000, 1_000_000_000]
    assert column(CL.classify(blocks(far).drop("action")), "action") == ["OMIT"] * 5


def test_enrichment_roles(blocks):
    df = blocks([
        _h("My Book", structural_tag="title"), _p("A short tale of it"), _h("Chapter 3: The Experiment", 2), _p("“Quoted body."),
        _h("Introduction", 2), _h("Scope", 2),
        _h("This is a long heading-like line that is actually prose from a bad extract and should not survive as a heading "
           "because it carries too many words for one", 2),
    ])
    out, meta = S.enrich(df)
    assert column(out, "semantic_role") == [
        "document_title", "subtitle", "chapter", "quote", "heading", "subheading", "paragraph"]
    m = meta.first()
    assert m["subtitle_pos"] == 1 and m["chapter_titles"] == ["Chapter 3: The Experiment"] and m["document_type"] == "general"


def test_refinement_never_promotes(blocks):
    df = blocks([
        _h("Chapter 2"), _p("body words go on and on without an end here"), _h("the it"), _p("lower case follows on"), _p("SHORT LABEL"),
    ])
    assert column(S.refine_headings(df.drop("structural_tag")), "type") == [
        "heading", "paragraph", "paragraph", "paragraph", "paragraph"]


def test_document_kind(blocks):
    df = blocks([_h("Chapter 1"), _h("Chapter 2"), _h("Chapter 3"), {"doc_id": 2, "text": "Solve the worksheet now"}])
    assert {r[0]: r[1] for r in S.document_kind(df).collect()} == {1: "book", 2: "educational"}


def test_book_is_not_repeated_in_filters(spark):
    """A filter on a book's columns does not fill the templates again, below the blocks."""
    kept = derived.book(spark, SF_DIR).filter((F.col("type") == "paragraph") & F.col("text").startswith("A"))
    filters = re.findall(r"Filter .*", kept._jdf.queryExecution().optimizedPlan().toString())
    assert filters and not any("regexp_replace" in f or "split" in f for f in filters)


def test_book_blocks_are_dealt_and_their_code_is_compiled(spark, capsys):
    """One file of one row group is many tasks' work; HotSpot interprets methods of more than 8 000 bytes."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        book = derived.book(spark, SF_DIR)
        assert book.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
        book.explain(mode="codegen")
        sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
        assert sizes and max(sizes) <= 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
