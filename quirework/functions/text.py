"""Text measures and row-level text rules as native Columns.

Nothing here uses Python UDFs: each rule is an expression tree Catalyst can fuse
with the scan, so a filter on any rule runs where the text is read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions import patterns as P


def _all(*conds: Column) -> Column:
    return reduce(lambda a, b: a & b, conds)


def _any(*conds: Column) -> Column:
    return reduce(lambda a, b: a | b, conds)


def blankless(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def apart(c: Column, rule: Callable[[Column], Column]) -> Column:
    """``rule`` of one text, outside the generated code of its stage.

    Rules by the dozen make a generated method too long for the JIT compiler; a loop over the matches of
    a pattern inside it, a letter or a word each, would be interpreted.
    """
    return F.transform(F.array(c), rule)[0]


def count_of(c: Column, pattern: str) -> Column:
    return apart(c, lambda t: F.regexp_count(t, F.lit(pattern)))


def _kept(c: Column, others: str) -> Column:
    """Characters left without those of ``others``, in a few long matches instead of one each."""
    return apart(c, lambda t: F.length(F.regexp_replace(t, f"{others}+", "")))


def squashed_tokens(sq: Column) -> Column:
    """White-space tokens of a squashed text: one more than it has spaces."""
    return F.when(sq == "", 0).otherwise(F.length(sq) - F.length(F.replace(sq, F.lit(" "), F.lit(""))) + 1)


def strip(c: Column) -> Column:
    return F.trim(blankless(c), F.lit(P.WS_CHARS))


def lstrip(c: Column) -> Column:
    return F.ltrim(blankless(c), F.lit(P.WS_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(blankless(c), F.lit(P.WS_CHARS))


def squash(c: Column) -> Column:
    """Collapse every white-space run to one space and trim."""
    return F.trim(F.regexp_replace(blankless(c), P.UNEVEN_SPACE, " "))


class Line:
    """The forms of one text the rules share: stripped, squashed, lower-cased, counted.

    Built from a raw column the forms are plain expressions; ``Line.prepare`` puts
    them in helper columns first, so that many rules over one text compute them once.
    """

    HELPERS = ("_st", "_sq", "_lower", "_lower_st", "_len_st", "_len_sq", "_words", "_tokens")

    def __init__(self, raw: Column, *forms: Column):
        self.raw = blankless(raw)
        st, sq = forms[:2] or (strip(raw), squash(raw))
        rest = forms[2:] or (F.lower(sq), F.lower(st), F.length(st), F.length(sq), count_of(st, P.WORD), squashed_tokens(sq))
        self.st, self.sq = st, sq
        self.low, self.low_st, self.n, self.nq, self.words, self.tokens = rest

    @classmethod
    def prepare(cls, df: DataFrame, column: str = "text") -> tuple[DataFrame, Line]:
        """Add the helper columns (drop them with ``df.drop(*Line.HELPERS)``)."""
        raw = F.col(column)
        st, sq = F.col("_st"), F.col("_sq")
        out = df.withColumns({"_st": strip(raw), "_sq": squash(raw)}).withColumns({
            "_lower": F.lower(sq), "_len_st": F.length(st), "_len_sq": F.length(sq),
            "_words": count_of(st, P.WORD), "_tokens": squashed_tokens(sq),
        }).withColumn("_lower_st", F.when(st == sq, F.col("_lower")).otherwise(F.lower(st)))
        return out, cls(raw, *[F.col(h) for h in cls.HELPERS])

    def count(self, pattern: str, *needed: str, lower: bool = False) -> Column:
        """Matches in the stripped text; the pattern runs only where one of the literals that every match holds occurs.

        With ``lower`` the literals are looked for in the lower-cased text.
        """
        return F.when(holds(self.low_st if lower else self.st, *needed), count_of(self.st, pattern)).otherwise(F.lit(0))


def holds(t: Column, *literals: str) -> Column:
    """Plain substring search, a fraction of the cost of a pattern."""
    return _any(*[t.contains(x) for x in literals])


Text = Column | Line


def line(c: Text) -> Line:
    return c if isinstance(c, Line) else Line(c)


def normalized(c: Column) -> Column:
    return squash(F.lower(blankless(c)))


def words_of(c: Column) -> Column:
    return F.filter(F.split(squash(c), " "), lambda w: w != "")


def has_text(c: Column) -> Column:
    return blankless(c).rlike(P.NS)


# --- measures -------------------------------------------------------------


def word_count(c: Column) -> Column:
    """Unicode word tokens."""
    return count_of(blankless(c), P.WORD)


def token_words(text: Column, cells: Column | None = None) -> Column:
    """White-space tokens of the text plus those of all table cells."""
    n = count_of(blankless(text), P.TOKEN)
    return n if cells is None else n + cell_words(cells)


def cell_words(cells: Column) -> Column:
    per_cell = F.transform(F.flatten(cells), lambda c: count_of(blankless(c), P.TOKEN))
    return F.coalesce(F.aggregate(per_cell, F.lit(0), lambda a, n: a + n), F.lit(0))


def token_count(c: Column, chars_per_token: int = 4) -> Column:
    """Model-token estimate, ceil(characters / n)."""
    return F.ceil(F.length(blankless(c)) / F.lit(chars_per_token)).cast("int")


def upper_ratio(c: Column) -> Column:
    letters = _kept(blankless(c), P.NOT_LETTER)
    return F.when(letters > 0, _kept(c, P.NOT_UPPER) / letters).otherwise(F.lit(0.0))


# --- sentence level -------------------------------------------------------


def split_sentences(c: Column) -> Column:
    """G1: sentences, with a dozen abbreviations protected from splitting."""
    t = blankless(c)
    for a in P.ABBREVIATIONS:
        t = F.replace(t, F.lit(a), F.lit(a[:-1] + P.ABBREVIATION_MARK))
    parts = F.split(t, f"(?<=[.!?]){P.S}+")
    whole = F.transform(
        parts, lambda s: strip(F.replace(s, F.lit(P.ABBREVIATION_MARK), F.lit(".")))
    )
    return F.filter(whole, lambda s: s != "")


def sentence_complete(c: Text) -> Column:
    """Blank, an ellipsis, or terminal punctuation with optional closers."""
    t = line(c).st
    last = F.right(F.rtrim(t, F.lit(P.CLOSERS)), F.lit(1))
    return (t == "") | t.endswith("...") | last.isin(*P.SENTENCE_ENDS)


def is_continuation(c: Text) -> Column:
    """P5: the first visible character is lower case or not a letter."""
    return line(c).raw.rlike(rf"^{P.S}*(?:\p{{Ll}}|[^\p{{L}}{P.WS}])")


def is_section_label(c: Text) -> Column:
    """P6."""
    x = line(c)
    return (x.sq != "") & (x.nq <= 120) & x.sq.rlike(P.SECTION_LABEL)


def is_citation_heavy(c: Text) -> Column:
    """P7."""
    x = line(c)
    t, low, n = x.st, x.low_st, x.n
    refs = x.count(P.BRACKET_REF, "[")
    years = x.count(P.whole(P.YEAR), "19", "20")
    return _any(
        holds(low, "http://", "https://", "www."),
        low.contains("doi:"), low.contains("arxiv:"), low.contains("isbn"),
        t.contains("©"), low.contains("(c)"),
        refs >= 2,
        (n < 400) & (refs >= 1) & (years >= 1),
        (n < 500) & (years >= 3),
        low.contains("et al") & (years >= 1),
    )


def is_symbol_heavy(c: Text) -> Column:
    """No tokens at all, or fewer than two words carrying a Latin letter."""
    x = line(c)
    return ~x.st.rlike(P.NS) | ((x.n > 8) & ~x.st.rlike(P.TWO_LATIN_WORDS))


def skip_sentence(c: Text) -> Column:
    """Sentences not worth sending to the model."""
    x = line(c)
    s = x.st
    return _any(
        s == "",
        (x.n < 30) & (x.words <= 1),
        s.rlike(P.FIGURE_CAPTION),
        is_citation_heavy(x),
        is_symbol_heavy(x),
    )


# --- page furniture -------------------------------------------------------


def is_running_header(c: Text) -> Column:
    """P10."""
    x = line(c)
    t, low, n = x.sq, x.low, x.nq
    piped = _any(
        low.startswith("contents "),
        low.startswith("table of contents"),
        t.rlike(rf"(?i)^(chapter|part){P.S}+[{P.WORD_CHARS}.]+{P.S}*\|"),
    )
    glued = t.rlike(P.opens(rf"contents{P.S}+(?:preface|introduction|foreword|part{P.S}+\d+)"))
    return F.when((n < 10) | (n > 420), F.lit(False)).when(t.contains("|"), piped).otherwise(
        ~low.startswith("contents of ") & (n <= 320) & glued
    )


def _nav_key(word: Column) -> Column:
    bare = F.regexp_replace(word, f"^[^{P.WORD_CHARS}]+|[^{P.WORD_CHARS}]+$", "")
    return F.lower(bare)


def strip_nav_crumbs(c: Column) -> Column:
    """Drop two to eight leading navigation labels glued to a sentence."""
    raw = strip(c)
    words = words_of(c)
    keys = F.transform(F.slice(words, 1, P.NAV_MAX_LEADING), _nav_key)
    flags = F.transform(keys, lambda k: k.isin(*P.NAV_CRUMBS))
    first_miss = F.array_position(flags, F.lit(False)).cast("int")
    lead = F.when(first_miss == 0, F.size(flags)).otherwise(first_miss - 1)
    rest = F.slice(words, lead + 1, F.greatest(F.size(words) - lead, F.lit(0)))
    guarded = (lead == 2) & F.coalesce(
        _nav_key(F.try_element_at(rest, F.lit(1))).isin(*P.NAV_GUARD_WORDS), F.lit(False)
    )
    keep = (F.size(words) < 3) | (lead < 2) | (F.size(rest) == 0) | guarded
    return F.when(keep, raw).otherwise(F.array_join(rest, " "))


def is_page_number(c: Text) -> Column:
    t = line(c).st
    return (t != "") & t.rlike(P.PAGE_NUMBER)


# --- contents pages -------------------------------------------------------


def is_toc_trigger(c: Text) -> Column:
    """P12."""
    n = line(c).low
    return n.isin(*P.TOC_TITLES) | n.startswith("table of content")


def is_toc_standalone(c: Text) -> Column:
    return (line(c).n <= 100) & is_toc_trigger(c)


def is_milestone_heading(c: Text) -> Column:
    """P13."""
    x = line(c)
    t = x.st
    return (x.n <= 200) & _any(
        t.rlike(P.MILESTONE_LABELLED),
        t.rlike(P.NUMBERED_TITLE),
        t.rlike(P.opens("prologue|epilogue|foreword|preface|introduction")),
        t.rlike(P.ROMAN_TITLE),
    )


def is_imprint(c: Text) -> Column:
    """Title-page and publisher boilerplate."""
    x = line(c)
    # A needle that holds another one adds nothing.
    shortest = [n for n in P.IMPRINT_NEEDLES if not any(m != n and m in n for m in P.IMPRINT_NEEDLES)]
    return (x.n <= 180) & holds(x.low, *shortest)


def is_toc_leader_row(c: Text) -> Column:
    """Dot leaders ending in a leaf page."""
    x = line(c)
    return _all(x.nq <= 260, holds(x.sq, *P.DOT_LEADERS), _ends_in_leaf(x.sq), ~is_imprint(c))


def _ends_in_leaf(squashed: Column) -> Column:
    """The text ends in a digit or a Roman numeral's letter, so in some page number."""
    return F.right(squashed, F.lit(1)).rlike(P.LEAF_CHARACTER)


def is_toc_heading_noise(c: Text) -> Column:
    """Heading text that is really a printed contents row."""
    x = line(c)
    t, n = x.sq, x.nq
    bare_label = t.rlike(
        rf"(?i)^(?:chapter{P.S}+\d{{1,3}}|part{P.S}+(?:[ivxlcdm]{{1,8}}|\d{{1,3}}))$"
    )
    numbered = t.rlike(rf"(?i)^(?:part|chapter|appendix){P.S}+\d+") & (
        t.rlike(P.SHORT_DOT_LEADER) | (x.words <= 16)
    )
    named = t.rlike(P.opens("conclusion|preface|introduction")) & (x.words <= 18)
    return (
        F.when((t == "") | is_imprint(c), F.lit(False))
        .when(is_toc_leader_row(c), F.lit(True))
        .otherwise((n < 200) & _ends_in_leaf(t) & (numbered | named) & ~bare_label)
    )


def is_toc_listing_row(c: Text) -> Column:
    """A plausible contents row: leaders, a trailing page, or a short stub."""
    x = line(c)
    t, n = x.st, x.n
    return _all(
        t != "",
        n <= 240,
        _any(
            holds(t, *P.DOT_LEADERS),
            _trailing_arabic(t),
            (n < 140) & _trailing_roman(t),
            (n < 120) & t.contains("[") & t.rlike(r"\[\d+\]"),
            (n < 96)
            & t.rlike(P.opens(rf"part{P.S}+[ivxlcdm\d]{{1,8}}|chapter{P.S}+\d{{1,3}}")),
        ),
        ~is_imprint(c),
    )


def _trailing_arabic(stripped: Column) -> Column:
    return F.right(stripped, F.lit(5)).rlike(P.TRAILING_ARABIC)


def _trailing_roman(stripped: Column) -> Column:
    return F.right(stripped, F.lit(13)).rlike(P.TRAILING_ROMAN)


def is_toc_row_in_contents(c: Text) -> Column:
    """Heading-shaped row that keeps an open contents region alive."""
    x = line(c)
    t, n = x.st, x.n
    number = r"(?:\d+\.\d+|\d+|[ivxlcdm]{1,8})"
    short = _any(
        (n <= 40) & x.low_st.rlike(rf"^(?:chapter|part){P.S}+{number}$"),
        (n <= 95) & (x.words <= 12) & t.rlike(P.opens(rf"(?:chapter|part){P.S}+{number}")),
        (n <= 120) & (x.words <= 14) & t.rlike(rf"^\d+\.\d+{P.NOT_BEFORE_WORD}"),
    )
    return is_toc_listing_row(c) | ((t != "") & (n <= 200) & short)


def chapter_mentions(c: Text) -> Column:
    return line(c).count(rf"(?i){P.NOT_AFTER_WORD}chapter{P.S}+\d+", "chapter", lower=True)


def is_merged_toc_blob(c: Text) -> Column:
    """A whole contents list or spine collapsed into one paragraph."""
    x = line(c)
    low, n = x.low_st, x.n
    questions = x.count(r"\?", "?")
    cover = low.rlike(P.whole("cover"))
    title_page = low.rlike(rf"title{P.S}+page")
    spine_words = ("cover", "dedication", "preface", "contents", "title page",
                   "acknowledgment", "acknowledgement")
    asked = ((n >= 70) & (questions >= 3)) | ((n >= 100) & (questions >= 2) & (x.words >= 40))

    def spine(hits: Column) -> Column:
        return _any(
            (hits >= 6) & (n >= 100),
            (hits >= 5) & (n >= 140) & low.rlike(P.whole("acknowledg|notes")),
            (hits >= 4) & (n >= 72),
            _all(
                n >= 45,
                hits >= 1,
                cover,
                low.rlike(P.whole(rf"chapter{P.S}+1")),
                ~low.rlike(P.whole(rf"chapter{P.S}+2")),
                low.rlike("dedication|preface") | title_page,
            ),
            (n >= 160) & (hits >= 3) & _any(*[low.contains(w) for w in spine_words]),
            (n >= 160) & (hits >= 2) & cover & title_page,
        )

    # What several conditions share Spark works out for every row, AND and OR or not; what stands in a CASE it does not.
    chaptered = F.when(low.contains("chapter"), apart(chapter_mentions(x), spine)).otherwise(F.lit(False))
    return F.when(n >= 45, asked | chaptered).otherwise(F.lit(False))


def starts_contents_region(c: Text) -> Column:
    """First line is a contents label and the next one, if any, a row."""
    lines = F.filter(
        F.transform(F.split(line(c).raw, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"),
                    strip),
        lambda s: s != "",
    )
    head = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    body = F.try_element_at(lines, F.lit(2))
    opened = _all(
        is_toc_trigger(head),
        F.length(head) <= 56,
        F.when(body.isNull(), F.lit(True)).otherwise(
            is_toc_leader_row(body) | is_toc_listing_row(body)
        ),
    )
    return F.when(line(c).low.contains("content"), opened).otherwise(F.lit(False))


def is_toc_body_opener(c: Text) -> Column:
    """P20: running prose that starts a preface or introduction."""
    x = line(c)
    t, n = x.st, x.n
    leaf = (n < 260) & (_trailing_arabic(t) | _trailing_roman(t))
    return _all(
        n >= 24,
        _any(
            x.low_st.startswith("preface ") & (x.words >= 10),
            x.low_st.startswith("introduction") & (x.words >= 18) & t.rlike(rf"(?i)^introduction{P.S}*[:.]?{P.S}*{P.NS}+"),
        ),
        ~holds(t, *P.DOT_LEADERS),
        ~leaf,
    )


def is_toc_leader_or_leaf(c: Text) -> Column:
    """P25: page-merge guard."""
    x = line(c)
    return (x.nq <= 160) & x.sq.contains("...") & _ends_in_leaf(x.sq)


def is_toc_prose_noise(c: Text) -> Column:
    """Body prose that leaked into generated contents."""
    x = line(c)
    stops = count_of(x.st, "[.?!]")
    wc = x.words
    return (x.n >= 90) & (wc >= 20) & ((stops >= 2) | ((wc >= 48) & (stops >= 1)))


# --- sections and headings ------------------------------------------------


def is_back_matter_heading(c: Text) -> Column:
    """The line is nothing but a back-matter title."""
    x = line(c)
    return (F.length(x.low) <= 200) & x.low.rlike(P.BACK_MATTER_TITLE)


def is_standalone_omit(c: Text) -> Column:
    """Short non-heading line that is only a back-matter title."""
    x = line(c)
    return (x.n < 120) & is_back_matter_heading(c) & ~x.st.rlike(P.SENTENCE_THEN_CAPITAL)


def is_copyright_block(c: Text) -> Column:
    """P22."""
    x = line(c)
    low = x.low_st
    return (x.n <= 600) & _any(
        x.st.contains("©"),
        low.contains("all rights reserved"),
        low.contains("isbn") & low.rlike(P.NOT_AFTER_WORD + P.ISBN_NUMBER),
    )


def is_distributor_boilerplate(c: Text) -> Column:
    """Download-site banner, unless it is the author's own site."""
    x = line(c)
    low = x.low_st
    own_site = _any(
        low.rlike(P.whole(P.AUTHOR_SITE)),
        low.rlike(P.whole(rf"visit{P.S}+me{P.S}+at")),
        low.rlike(P.whole(rf"author'?s{P.S}+website")),
    )
    return (x.n <= 260) & _any(
        low.contains("manybooks.net"),
        low.contains("manybooks.org"),
        low.contains("ebook") & x.st.rlike(P.FREE_EBOOK + P.NOT_BEFORE_WORD),
    ) & ~own_site


def is_chapter_like(c: Text) -> Column:
    """Wording that opens a part, chapter or numbered section."""
    t = line(c).sq
    low = line(c).low
    after_section = r"(?!\.\d)(?! (?:of|in|on|for|that|which|the|a|an) )"
    return (line(c).nq <= 220) & _any(
        low.rlike(P.opens("chapter|part|appendix|annex")),
        t.rlike(r"^\d{1,3}$"),
        low.rlike(P.opens(
            r"(?:law|narrative|lesson|unit|lecture|episode|module|segment) (?:\d+|[a-z]+)")),
        low.rlike(P.opens(r"book (?:[ivxlcdm]{1,8}|\d{1,3})|act [ivxlcdm]{1,8}|principle \d{1,3}")),
        low.rlike(rf"^section \d{{1,3}}{P.NOT_BEFORE_WORD}{after_section}"),
        t.rlike(rf"^\d{{1,2}}\.\d{{1,3}} {P.NS}"),
    )


def is_caps_emphasis(c: Text) -> Column:
    """A shouted mid-paragraph line, not a heading."""
    x = line(c)
    t, wc, n = x.sq, x.tokens, x.nq
    return _all(
        n >= 6, n <= 130, wc >= 2, wc <= 14,
        _kept(t, P.NOT_LETTER) >= 4,
        upper_ratio(t) >= 0.88,
        t.rlike(r"""!["'\x{201d}\x{2019}]?$"""),
    )


def is_typographic_heading(c: Text) -> Column:
    """Body-sized all-caps line that reads as a section title."""
    x = line(c)
    t, wc = x.sq, x.tokens
    return _all(
        x.nq >= 3, x.nq <= 120, wc >= 1, wc <= 11,
        ~(t.endswith(".") & (wc > 5)),
        ~t.endswith(","), ~t.endswith(";"),
        ~(t.contains(",") & (wc >= 6)),
        upper_ratio(t) >= 0.88,
        ~is_caps_emphasis(c),
    )


def is_toc_spill(c: Text) -> Column:
    """Contents list merged into one extracted line."""
    x = line(c)
    n, wc = x.nq, x.tokens
    q = x.count(r"\?", "?")
    return (n >= 60) & _any(
        q >= 3, (n >= 100) & (q >= 2) & (wc >= 35), (chapter_mentions(x) >= 2) & (wc >= 25)
    )


def is_list_line(c: Text) -> Column:
    return line(c).st.rlike(rf"^(?:[-*•]|\d+[.)]){P.S}+")


def is_ordered_line(c: Text) -> Column:
    return line(c).st.rlike(rf"^\d+[.)]{P.S}+")


def is_multi_sentence(c: Text) -> Column:
    return (line(c).n >= 42) & line(c).st.rlike(P.MULTI_SENTENCE)


def supports_heading(c: Text) -> Column:
    """A following line short and title-like enough to back a one-word heading."""
    x = line(c)
    t = x.st
    return F.coalesce(
        _all(
            x.n <= 140, x.words <= 14,
            t.rlike(rf"^{P.UPPER}"), ~t.endswith("."),
        ),
        F.lit(False),
    )


def decimal_outline_split(c: Text) -> Column:
    """P26: "1.1 A 1.2 B 1.3 C" to its items, else null."""
    def items(t: Column) -> Column:
        parts = F.split(t, r" (?=\d+\.\d+ )")
        ok = _all(
            F.length(t) >= 30,
            count_of(t, P.whole(r"\d+\.\d+")) >= 3,
            F.size(parts) >= 3,
            F.forall(parts, lambda p: p.rlike(rf"^\d+\.\d+{P.NOT_BEFORE_WORD}")),
        )
        return F.when(ok, parts)

    t = line(c).sq
    return F.when(t.rlike(r"\d\.\d"), apart(t, items))


def ends_with_stub(c: Text) -> Column:
    return line(c).st.rlike(rf"(?i){P.REPEAT_STUB}[\"\x{{201d}}\x{{2019}}{P.WS}]*$")


def is_likely_truncated(c: Text) -> Column:
    """Odd straight quotes, an unclosed curly quote, or the fixed stub."""
    x = line(c)
    return (x.n >= 20) & _any(
        x.low_st.contains("stop!") & ends_with_stub(c),
        x.count('"', '"') % 2 == 1,
        x.st.contains("“") & (count_of(x.st, "“") > count_of(x.st, "”")),
    )


def opens_with_quote(c: Text) -> Column:
    """P29."""
    return line(c).st.rlike(r'^[\x{201c}\x{201e}«"]')


def is_retryable(status: Column) -> Column:
    """P30."""
    return status.isNull() | status.isin(429, 502, 503, 504)
