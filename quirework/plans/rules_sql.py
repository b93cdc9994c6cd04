"""SQL statements of the text rules, used by the checks (RE2 syntax)."""

from __future__ import annotations

from quirework.functions import patterns as P
from quirework.plans.duck import (
    all_of, any_of, cnt, has, opens, q, squash, strip, sub, tokens, upper_ratio, whole, words,
)

ST, SQ = "st", "sq"  # stripped and squashed text, computed once by TEXT_VIEW
LOW = f"lower({SQ})"


def text_view(source: str, name: str = "tv") -> str:
    return f"{name} AS (SELECT *, {strip('text')} AS {ST}, {squash('text')} AS {SQ} FROM {source})"


def in_list(x: str, values: tuple[str, ...]) -> str:
    return f"{x} IN ({', '.join(q(v) for v in values)})"


imprint = all_of(f"length({ST}) <= 180", any_of(*[f"contains({LOW}, {q(n)})" for n in P.IMPRINT_NEEDLES]))
complete = any_of(f"{ST} = ''", f"ends_with({ST}, '...')", has(ST, P.COMPLETE_END))
continuation = has(ST, rf"^(?:\p{{Ll}}|[^\p{{L}}{P.WS}])")
section_label = all_of(f"{SQ} <> ''", f"length({SQ}) <= 120", has(SQ, P.SECTION_LABEL))
_years = cnt(ST, rf"\b{P.YEAR}\b")
_refs = cnt(ST, P.BRACKET_REF)
citation = any_of(
    has(ST, P.URL), f"contains(lower({ST}), 'doi:')", f"contains(lower({ST}), 'arxiv:')",
    f"contains(lower({ST}), 'isbn')", f"contains({ST}, '©')", f"contains(lower({ST}), '(c)')",
    f"{_refs} >= 2", f"{_refs} >= 1 AND {_years} >= 1 AND length({ST}) < 400",
    f"{_years} >= 3 AND length({ST}) < 500", f"contains(lower({ST}), 'et al') AND {_years} >= 1",
)
symbol_heavy = any_of(
    f"{ST} = ''",
    f"len(list_filter(regexp_extract_all({ST}, {q(P.WORD)}), lambda w: {has('w', '[A-Za-z]')})) < 2"
    f" AND length({ST}) > 8",
)
skip = any_of(
    f"{ST} = ''", f"{words(ST)} <= 1 AND length({ST}) < 30", has(ST, P.FIGURE_CAPTION), citation, symbol_heavy
)
running_header = f"""CASE WHEN length({SQ}) < 10 OR length({SQ}) > 420 THEN false
  WHEN contains({SQ}, '|') THEN {any_of(
      f"starts_with({LOW}, 'contents ')", f"starts_with({LOW}, 'table of contents')",
      has(SQ, rf"(?i)^(chapter|part){P.S}+[{P.WORD_CHARS}.]+{P.S}*\|"))}
  ELSE {all_of(f"NOT starts_with({LOW}, 'contents of ')", f"length({SQ}) <= 320",
               has(SQ, opens(rf"contents{P.S}+(?:preface|introduction|foreword|part{P.S}+\d+)")))} END"""
toc_trigger = any_of(in_list(LOW, P.TOC_TITLES), f"starts_with({LOW}, 'table of content')")
toc_standalone = all_of(f"length({ST}) <= 100", toc_trigger)
milestone = all_of(f"length({ST}) <= 200", any_of(
    has(ST, P.MILESTONE_LABELLED), has(ST, P.NUMBERED_TITLE),
    has(ST, opens("prologue|epilogue|foreword|preface|introduction")), has(ST, P.ROMAN_TITLE)))
leader_row = all_of(f"NOT {imprint}", f"length({SQ}) <= 260", has(SQ, P.DOT_LEADER), has(SQ, P.LEAF_PAGE))
_bare = has(SQ, rf"(?i)^(?:chapter{P.S}+\d{{1,3}}|part{P.S}+(?:[ivxlcdm]{{1,8}}|\d{{1,3}}))$")
heading_noise = f"""CASE WHEN {SQ} = '' OR {imprint} THEN false WHEN {leader_row} THEN true
  ELSE {all_of(f"length({SQ}) < 200", f"NOT {_bare}", has(SQ, P.LEAF_PAGE), any_of(
      all_of(has(SQ, rf"(?i)^(?:part|chapter|appendix){P.S}+\d+"),
             any_of(has(SQ, P.SHORT_DOT_LEADER), f"{words(SQ)} <= 16")),
      all_of(has(SQ, opens("conclusion|preface|introduction")), f"{words(SQ)} <= 18")))} END"""
listing_row = all_of(f"{ST} <> ''", f"NOT {imprint}", f"length({ST}) <= 240", any_of(
    has(ST, P.DOT_LEADER), has(ST, P.TRAILING_ARABIC),
    all_of(f"length({ST}) < 140", has(ST, P.TRAILING_ROMAN)),
    all_of(f"length({ST}) < 120", has(ST, r"\[\d+\]")),
    all_of(f"length({ST}) < 96", has(ST, opens(rf"part{P.S}+[ivxlcdm\d]{{1,8}}|chapter{P.S}+\d{{1,3}}")))))
_num = r"(?:\d+\.\d+|\d+|[ivxlcdm]{1,8})"
row_in_contents = any_of(listing_row, all_of(f"{ST} <> ''", f"length({ST}) <= 200", any_of(
    all_of(f"length({ST}) <= 40", has(f"lower({ST})", rf"^(?:chapter|part){P.S}+{_num}$")),
    all_of(has(ST, opens(rf"(?:chapter|part){P.S}+{_num}")), f"{words(ST)} <= 12", f"length({ST}) <= 95"),
    all_of(has(ST, rf"^\d+\.\d+($|[^{P.WORD_CHARS}])"), f"{words(ST)} <= 14", f"length({ST}) <= 120"))))
_hits = cnt(ST, rf"(?i)\bchapter{P.S}+\d+")
_marks = cnt(ST, r"\?")
_low = f"lower({ST})"
merged_blob = any_of(
    f"length({ST}) >= 70 AND {_marks} >= 3", f"length({ST}) >= 100 AND {_marks} >= 2 AND {words(ST)} >= 40",
    f"{_hits} >= 6 AND length({ST}) >= 100",
    all_of(f"{_hits} >= 5", f"length({ST}) >= 140", has(_low, whole("acknowledg|notes"))),
    f"{_hits} >= 4 AND length({ST}) >= 72",
    all_of(f"length({ST}) >= 45", f"{_hits} >= 1", has(_low, whole("cover")),
           has(_low, whole(rf"chapter{P.S}+1")), f"NOT {has(_low, whole(rf'chapter{P.S}+2'))}",
           has(_low, rf"dedication|preface|title{P.S}+page")),
    all_of(f"length({ST}) >= 160", f"{_hits} >= 3", has(
        _low, "cover|dedication|preface|contents|title page|acknowledgment|acknowledgement")),
    all_of(f"length({ST}) >= 160", f"{_hits} >= 2", has(_low, whole("cover")), has(_low, rf"title{P.S}+page")),
)
body_opener = all_of(
    f"length({ST}) >= 24", f"NOT {has(ST, P.DOT_LEADER)}",
    f"NOT (length({ST}) < 260 AND {any_of(has(ST, P.TRAILING_ARABIC), has(ST, P.TRAILING_ROMAN))})",
    any_of(all_of(f"starts_with({_low}, 'preface ')", f"{words(ST)} >= 10"),
           all_of(has(ST, rf"(?i)^introduction{P.S}*[:.]?{P.S}*{P.NS}+"), f"{words(ST)} >= 18")))
leader_or_leaf = all_of(f"length({SQ}) <= 160", f"contains({SQ}, '...')", has(SQ, P.LEAF_PAGE_SHORT_ROMAN))
prose_noise = all_of(f"length({ST}) >= 90", f"{words(ST)} >= 20", any_of(
    f"{cnt(ST, '[.?!]')} >= 2", f"{words(ST)} >= 48 AND {cnt(ST, '[.?!]')} >= 1"))
back_matter = all_of(f"length({SQ}) <= 200", has(LOW, P.BACK_MATTER_TITLE))
standalone_omit = all_of(f"length({ST}) < 120", back_matter, f"NOT {has(ST, P.SENTENCE_THEN_CAPITAL)}")
copyright_block = all_of(f"length({ST}) <= 600", any_of(
    f"contains({ST}, '©')", f"contains({_low}, 'all rights reserved')",
    has(_low, rf"(^|[^{P.WORD_CHARS}]){P.ISBN_NUMBER}")))
distributor = all_of(f"length({ST}) <= 260", f"NOT {has(_low, whole(P.AUTHOR_SITE))}",
                     any_of(f"contains({_low}, 'manybooks.net')", f"contains({_low}, 'manybooks.org')",
                            has(ST, P.FREE_EBOOK)))
chapter_like = all_of(f"length({SQ}) <= 220", any_of(
    has(LOW, opens("chapter|part|appendix|annex")), has(SQ, r"^\d{1,3}$"),
    has(LOW, opens(r"(?:law|narrative|lesson|unit|lecture|episode|module|segment) (?:\d+|[a-z]+)")),
    has(LOW, opens(r"book (?:[ivxlcdm]{1,8}|\d{1,3})|act [ivxlcdm]{1,8}|principle \d{1,3}")),
    all_of(has(LOW, opens(r"section \d{1,3}")), f"NOT {has(LOW, r'^section \d{1,3}\.\d')}",
           f"NOT {has(LOW, r'^section \d{1,3} (of|in|on|for|that|which|the|a|an) ')}"),
    has(SQ, rf"^\d{{1,2}}\.\d{{1,3}} {P.NS}")))
caps_emphasis = all_of(
    f"length({SQ}) BETWEEN 6 AND 130", f"{tokens(SQ)} BETWEEN 2 AND 14", f"{cnt(SQ, P.LETTER)} >= 4",
    f"{upper_ratio(SQ)} >= 0.88", has(SQ, r"""!["'\x{201d}\x{2019}]?$"""))
typographic = all_of(
    f"length({SQ}) BETWEEN 3 AND 120", f"{tokens(SQ)} BETWEEN 1 AND 11",
    f"NOT (ends_with({SQ}, '.') AND {tokens(SQ)} > 5)", f"NOT {has(SQ, '[,;]$')}",
    f"NOT (contains({SQ}, ',') AND {tokens(SQ)} >= 6)", f"{upper_ratio(SQ)} >= 0.88", f"NOT {caps_emphasis}")
toc_spill = all_of(f"length({SQ}) >= 60", any_of(
    f"{cnt(SQ, r'\?')} >= 3", f"length({SQ}) >= 100 AND {cnt(SQ, r'\?')} >= 2 AND {tokens(SQ)} >= 35",
    f"{cnt(SQ, rf'(?i)\bchapter{P.S}+\d+')} >= 2 AND {tokens(SQ)} >= 25"))
list_line = has(ST, rf"^(?:[-*•]|\d+[.)]){P.S}+")
page_number = all_of(f"{ST} <> ''", has(ST, P.PAGE_NUMBER))
truncated = all_of(f"length({ST}) >= 20", any_of(
    has(ST, rf'(?i){P.REPEAT_STUB}["\x{{201d}}\x{{2019}}{P.WS}]*$'),
    f"{cnt(ST, chr(34))} % 2 = 1", f"{cnt(ST, '“')} > {cnt(ST, '”')}"))
quote_opening = has(ST, r'^[\x{201c}\x{201e}«"]')
multi_sentence = all_of(f"length({ST}) >= 42", has(ST, P.MULTI_SENTENCE))
supports_heading = all_of(f"{words(ST)} <= 14", f"length({ST}) <= 140", has(ST, rf"^{P.UPPER}"),
                          f"NOT ends_with({ST}, '.')")
_outline = f"string_split({sub(SQ, r' (\d+\.\d+ )', chr(30) + chr(92) + '1')}, chr(30))"
outline_items = f"""CASE WHEN {all_of(
    f"length({SQ}) >= 30", f"{cnt(SQ, r'\b\d+\.\d+\b')} >= 3", f"len({_outline}) >= 3",
    f"len(list_filter({_outline}, lambda p: NOT {has('p', rf'^\d+\.\d+($|[^{P.WORD_CHARS}])')})) = 0")}
  THEN array_to_string({_outline}, ' / ') END"""
nav_lead = f"""len(regexp_extract({SQ}, {q(
    rf"(?i)^((?:[^{P.WORD_CHARS} ]*(?:{'|'.join(P.NAV_CRUMBS)})[^{P.WORD_CHARS} ]* ){{0,8}})")}, 1)
  .string_split(' ')) - 1"""
