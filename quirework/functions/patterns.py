"""Character classes, patterns and word lists the text rules rest on.

The patterns are written so that both Java (Spark) and RE2 (the SQL check) read
them the same way; lookarounds are added only by the Spark-side helpers below.
"""

from __future__ import annotations

# Unicode white space as the text rules understand it (wider than Java's \s).
WS = r"\x09-\x0d\x1c-\x20\x{85}\p{Z}"
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
S = f"[{WS}]"
NS = f"[^{WS}]"
WORD_CHARS = r"\p{L}\p{N}_"
W = f"[{WORD_CHARS}]"
WORD = f"{W}+"
TOKEN = f"{NS}+"
LETTER = r"\p{L}"
UPPER = r"\p{Lu}"
NOT_LETTER = r"\P{L}"
NOT_UPPER = r"\P{Lu}"

# --- sentence level -------------------------------------------------------
ABBREVIATIONS = (
    "e.g.", "i.e.", "et al.", "Fig.", "fig.", "Dr.",
    "Mr.", "Mrs.", "Ms.", "vs.", "Inc.", "Ltd.",
)
ABBREVIATION_MARK = "\uffff"
SENTENCE_BREAK = rf"([.!?]){S}+"
SENTENCE_ENDS = (".", "!", "?", "…", "।")
CLOSERS = "'\"\u201d\u2019)]"
COMPLETE_END = rf"""[.!?…।]['"\x{{201d}}\x{{2019}})\]]*{S}*$"""
MULTI_SENTENCE = rf"""[.!?…]["'\x{{201d}}\x{{2019}})\]]*{S}+[A-Z\x{{c0}}-\x{{1fff}}]"""
SENTENCE_THEN_CAPITAL = rf"[.!?]{S}+[A-Z]"
SECTION_LABEL = (
    rf"(?i)^(?:preface|introduction|foreword|prologue|epilogue|acknowledg(?:e)?ments?|dedication"
    rf"|contents?|table of contents|(?:part|book){S}+[ivxlcdm\d]+|chapter{S}+\d+"
    rf"|appendix{S}+[a-z0-9]+|notes?|references?|bibliography|glossary|index){S}*$"
)
YEAR = r"(?:19|20)\d{2}"
BRACKET_REF = rf"\[[\d,{WS}\x{{2013}}-]+\]"
URL = r"(?i)https?://|www\."
FIGURE_CAPTION = rf"(?i)^(figure|fig\.?|table){S}+\d+([.:){WS}]|$)[^\n]{{0,40}}$"

# --- page furniture -------------------------------------------------------
NAV_CRUMBS = (
    "notes", "index", "preface", "foreword", "contents", "bibliography", "glossary",
    "illustrations", "abbreviations", "dedication", "acknowledgments",
    "acknowledgements", "appendix", "appendices",
)
NAV_GUARD_WORDS = ("to", "of", "for", "and", "on", "in", "by", "about", "from", "with", "at")
NAV_MAX_LEADING = 8
PAGE_NUMBER = rf"(?i)^[^{WORD_CHARS}]*\d{{1,4}}[^{WORD_CHARS}]*$|^page{S}+\d{{1,4}}[^{WORD_CHARS}]*$"

# --- contents pages and headings -----------------------------------------
TOC_TITLES = ("table of contents", "contents", "table of content", "contents page")
IMPRINT_NEEDLES = (
    "from the russian", "from the french", "from the german", "from the polish",
    "translated by", "translation by",
    "printed in great britain", "printed in the united states", "printed in england", "printed in",
    "macmillan company", "macmillan co", "macmillan",
    "constance garnett", "the novels of", "and other stories by", "and other tales by",
    "all rights reserved", "copyright", "publisher", "publishers", "publishing",
    "limited", "ltd.", " inc.", "press",
    "vintage books", "penguin", "random house", "harpercollins",
    "fyodor dostoevsky", "fyodor dostoyevsky", "f. m. dostoevsky", "fiodor dostoevsky",
    "dostoevsky", "dostoyevsky",
)
DOT_LEADER = r"\.{3,}|\x{2026}"
DOT_LEADERS = ("...", "\u2026")
SHORT_DOT_LEADER = r"\.{2,}|\x{2026}"
LEAF_PAGE = rf"(?i)(?:\d{{1,4}}|[ivxlcdm]{{1,12}}){S}*$"
LEAF_CHARACTER = "[0-9ivxlcdmIVXLCDM]"
LEAF_PAGE_SHORT_ROMAN = rf"(?i)(?:\d{{1,4}}|[ivxlcdm]{{1,10}}){S}*$"
TRAILING_ARABIC = rf"{S}\d{{1,4}}{S}*$"
TRAILING_ROMAN = rf"(?i){S}+[ivxlcdm]{{1,12}}{S}*$"
MILESTONE_LABELLED = (
    rf"""(?i)^(chapter|part|section|book){S}+[{WORD_CHARS}"'\x{{2018}}\x{{2019}}\x{{201c}}\x{{201d}},.;:\x{{2014}}-]+"""
)
NUMBERED_TITLE = rf"^\d+[.)]{S}+{NS}"
ROMAN_TITLE = rf"^[IVXLC]+\.{S}+{NS}"
BACK_MATTER_TITLE = (
    r"^(index(es)?|(subject|author) index|notes?|endnotes?|footnotes?|references?|reference list"
    r"|works? cited|bibliography|citations?"
    rf"|glossary( of [{WORD_CHARS} \-:,'\x{{2019}}/&;]+)?"
    rf"|appendix( [{WORD_CHARS} \-:,'\x{{2019}}/]+)?|annex( [{WORD_CHARS} \-:,'\x{{2019}}/]+)?"
    r"|copyrights?|copyright(notice|information|page|©)?|legalnotices?|imprint"
    r"|list of figures|list of tables|about the authors?)$"
)
ISBN_NUMBER = rf"isbn[{WS}:-]*[\d\-]{{8,}}"
AUTHOR_SITE = rf"(?:my|our){S}+(?:website|blog|site|page|books|novels)"
FREE_EBOOK = rf"(?i)^{S}*a{S}+free{S}+ebook{S}+from"
FRONT_MATTER_LABELS = (
    "title page", "copyright", "dedication", "epigraph", "table of contents", "contents",
    "table of content", "foreword", "preface", "introduction", "prologue",
    "acknowledgments", "acknowledgements",
)
ACADEMIC_LABELS = (
    "abstract", "objective", "methodology", "methods", "materials and methods", "discussion",
    "results", "conclusion", "conclusions", "references", "reference", "appendix",
    "bibliography", "glossary", "index",
)
SUBHEADING_LABELS = (
    "summary", "key takeaways", "main idea", "interpretation", "analysis", "example",
    "case study", "story", "judgment", "judgement", "exercise", "exercises", "notes", "tips",
    "warning", "important", "remember", "overview", "background", "highlights",
    "discussion questions", "action steps", "final thoughts", "observance of the law", "reversal",
)
AMBIGUOUS_WORDS = (
    "judgment", "judgement", "interpretation", "conclusion", "analysis", "summary", "notes",
    "note", "warning", "important", "remember", "example", "story", "exercise", "introduction",
    "abstract", "results", "discussion", "index", "references", "principle", "scene",
)

# --- near-duplicate clean-up ---------------------------------------------
REPEAT_OPENER = rf"(?:ye|yeh){S}+(?:ais(?:e|a)|esa|esi){S}+hai{S}+jaise"
#: Every opener ends in it.
REPEAT_OPENER_END = "jaise"
REPEAT_STUB = rf"STOP!{S}*YEH?{S}*EK"
OVERLAP_QUOTES = "\"“”‘’`"

# --- model output clean-up -----------------------------------------------
ECHO_PHRASE = rf"to{S}*={S}*json{S}+code"

# --- files and languages --------------------------------------------------
ALLOWED_SUFFIXES = (
    ".pdf", ".docx", ".epub", ".ebup", ".txt", ".png", ".jpg", ".jpeg",
    ".webp", ".tiff", ".tif", ".gif", ".bmp",
)
HINDI_ALIASES = ("hindi", "hi", "devanagari", "devnagari")
UNSAFE_FILENAME_CHARS = r'[<>:"/\\|?*\x00-\x1f]'

# --- Spark-only assertions and possessive runs (RE2 has none) --------------
#: White space other than one plain space between two other characters; most texts have none.
UNEVEN_SPACE = rf"[{WS}&&[^ ]]{S}*+| {S}++"
TWO_LATIN_WORDS = f"[A-Za-z]{W}*+[^{WORD_CHARS}][^A-Za-z]*+[A-Za-z]"
NOT_AFTER_WORD = f"(?<!{W})"
NOT_BEFORE_WORD = f"(?!{W})"


def whole(pattern: str) -> str:
    """Pattern standing between Unicode word boundaries (word characters inside)."""
    return f"{NOT_AFTER_WORD}(?:{pattern}){NOT_BEFORE_WORD}"


def opens(pattern: str) -> str:
    """Pattern at the start of the text, ending on a Unicode word boundary."""
    return f"(?i)^(?:{pattern}){NOT_BEFORE_WORD}"
