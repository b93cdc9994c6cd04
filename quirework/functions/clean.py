"""Text clean-up and display functions (F-family) as native Columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quirework.functions import patterns as P
from quirework.functions.text import apart, blankless, rstrip, squash, strip

_NEWLINES = r"\r\n|\r"


def _nfc(c: Column) -> Column:
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))

    return F.pandas_udf(compose, "string")(c)


def clean_control_chars(c: Column, nfc: bool = False) -> Column:
    """drop NULs and a leading BOM, blank out other control characters.

    Canonical composition has no built-in, so ``nfc=True`` adds one Arrow UDF,
    and only for rows holding a character that composition could change.
    """
    t = F.regexp_replace(blankless(c), r"\x00", "")
    t = F.regexp_replace(t, r"^\x{feff}", "")
    t = F.regexp_replace(t, r"[\x01-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]", " ")
    if not nfc:
        return t
    return F.when(t.rlike(r"[^\x00-\x{2ff}]"), _nfc(t)).otherwise(t)


def strip_markdown(c: Column) -> Column:
    """headings, emphasis, code ticks and link targets."""
    t = F.regexp_replace(blankless(c), _NEWLINES, "\n")
    t = F.regexp_replace(t, rf"(?m)^#{{1,6}}{P.S}+", "")
    for _ in range(3):
        t = F.regexp_replace(t, r"\*\*([^*]+)\*\*", "$1")
        t = F.regexp_replace(t, "__([^_]+)__", "$1")
        t = F.regexp_replace(t, r"(?<!\*)\*(?!\*)([^*]+)\*(?!\*)", "$1")
        t = F.regexp_replace(t, "(?<!_)_(?!_)([^_]+)_(?!_)", "$1")
    t = F.regexp_replace(t, r"\*\*|__|`", "")
    return strip(F.regexp_replace(t, r"\[([^\]]+)\]\([^)]+\)", "$1"))


def reflow(c: Column) -> Column:
    """join hard-wrapped lines, keep blank-line stanzas."""
    t = strip(F.regexp_replace(blankless(c), _NEWLINES, "\n"))
    stanzas = F.split(t, rf"\n{P.S}*\n+")
    joined = F.transform(
        stanzas,
        lambda s: F.array_join(
            F.filter(F.transform(F.split(s, "\n"), strip), lambda x: x != ""), " "
        ),
    )
    return F.array_join(F.filter(joined, lambda s: s != ""), "\n\n")


def clean_paragraph(c: Column) -> Column:
    """F2 and F3; a text without a mark or a line break, as most are, only loses the white space around it."""
    t = blankless(c)
    return F.when(t.rlike(r"[*_`\[#\r\n]"), apart(t, lambda x: reflow(strip_markdown(x)))).otherwise(strip(t))


def list_lines(c: Column) -> Column:
    lines = F.split(blankless(c), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")
    return F.filter(lines, lambda s: s.rlike(P.NS))


def list_is_ordered(text: Column, list_kind: Column) -> Column:
    """the declared kind, else ordered when any line is numbered."""
    numbered = F.exists(list_lines(text), lambda s: s.rlike(rf"^{P.S}*\d+[.)]{P.S}+"))
    return (
        F.when(list_kind == "ordered", F.lit(True))
        .when(list_kind == "bullet", F.lit(False))
        .otherwise(numbered)
    )


def list_items(text: Column, list_kind: Column) -> Column:
    """item texts without their bullet or number."""
    ordered = list_is_ordered(text, list_kind)

    def bare(s: Column) -> Column:
        t = clean_paragraph(s)
        numbered = F.regexp_replace(t, rf"^\d+[.)]{P.S}+", "")
        bulleted = F.regexp_replace(t, rf"^[-*•]{P.S}+", "")
        return strip(F.when(ordered, numbered).otherwise(bulleted))

    items = F.filter(F.transform(list_lines(text), bare), lambda s: s != "")
    whole = F.filter(F.array(bare(text)), lambda s: s != "")
    return F.when(F.size(items) > 0, items).otherwise(whole)


# canonical opening words of front-matter and part headings (fixed values)
_DISPLAY_OPENERS = (
    ("preface", "Preface"),
    ("introduction", "Introduction"),
    ("acknowledg(?:e)?ments?", "Acknowledgments"),
    ("chapter", "Chapter"),
    ("part", "Part"),
)


def display_heading(c: Column) -> Column:
    """canonical casing for the opening keyword, the rest untouched."""
    t = squash(c)
    out = t
    for pattern, shown in reversed(_DISPLAY_OPENERS):
        rest = F.regexp_replace(t, P.opens(pattern) + " ?", "")
        out = F.when(t.rlike(P.opens(pattern)), F.trim(F.concat(F.lit(shown + " "), rest))).otherwise(out)
    return out


def is_display_milestone(c: Column) -> Column:
    return squash(c).rlike(P.opens("|".join(p for p, _ in _DISPLAY_OPENERS)))


def overlap_key(c: Column) -> Column:
    """lower-cased, squashed, quotes dropped."""
    return F.translate(squash(F.lower(blankless(c))), P.OVERLAP_QUOTES, "")


def slug(c: Column) -> Column:
    """F7."""
    s = F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.when(s == "", F.lit("section")).otherwise(s)


def output_filename(name: Column, language: Column, extension: Column, max_stem: int = 180) -> Column:
    """F8: ``{safe stem}-{language}.{ext}``."""
    base = F.regexp_extract(name, r"([^/]*)/*$", 1)
    stem = F.when(base.rlike(r"^.+\.[^.]+$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    stem = F.regexp_replace(stem, P.UNSAFE_FILENAME_CHARS, "_")
    stem = F.regexp_replace(stem, r"^[ .]+|[ .]+$", "")
    stem = F.when(stem == "", F.lit("document")).otherwise(stem)
    stem = F.when(
        F.length(stem) > max_stem, F.regexp_replace(F.substring(stem, 1, max_stem), r"[ .]+$", "")
    ).otherwise(stem)
    ext = F.lower(F.regexp_replace(extension, r"^\.+", ""))
    return F.concat(stem, F.lit("-"), language, F.lit("."), ext)


def translation_target(c: Column) -> Column:
    """F9."""
    return F.when(F.lower(strip(c)).isin(*P.HINDI_ALIASES), "hindi").otherwise("hinglish")


def target_label(c: Column) -> Column:
    return F.initcap(translation_target(c))


def optional_text(c: Column, max_len: int) -> Column:
    """trim, blank becomes null, cut to length."""
    t = strip(c)
    return F.when(c.isNotNull() & (t != ""), F.substring(t, 1, max_len))


def referral_code(c: Column) -> Column:
    return F.lower(strip(c))


def email_key(c: Column) -> Column:
    return F.nullif(F.lower(strip(c)), F.lit(""))


def device_hash(c: Column) -> Column:
    t = strip(c)
    return F.when(c.isNotNull() & (F.length(t) >= 8), F.sha2(t, 256))


def error_message(raw: Column, status: Column, error_class: Column, max_len: int = 420) -> Column:
    """one short line; HTML bodies are replaced by a hint."""
    text = strip(raw)
    text = F.when(text == "", error_class).otherwise(text)
    low = F.lower(text)
    html = text.rlike(rf"(?is)<{P.S}*!DOCTYPE{P.S}+html{P.S}*>|<{P.S}*html(?!{P.W})") | (
        low.contains("<html") & (low.contains("<head") | low.contains("<body"))
    )
    short = F.when(
        F.length(text) > max_len, F.concat(F.substring(text, 1, max_len - 3), F.lit("..."))
    ).otherwise(text)
    body = F.when(html, F.lit("received an HTML page instead of JSON")).otherwise(short)
    prefix = F.when(
        status.isNotNull(), F.concat(F.lit("API error (HTTP "), status.cast("string"), F.lit("): "))
    ).otherwise(F.lit("API error: "))
    return F.concat(prefix, body)


def first_epoch(*cols: Column) -> Column:
    """first of several epoch-second fields that parses."""
    return F.coalesce(*[F.timestamp_seconds(c.try_cast("bigint")) for c in cols])


def outline_indent(text: Column, is_heading: Column, level: Column) -> Column:
    """indent in points from heading level or decimal numbering."""
    raw = blankless(text)
    base = F.length(F.regexp_extract(raw, f"^({P.S}+)", 1)) * 6.0
    bare = F.regexp_replace(raw, f"^{P.S}+", "")
    token = F.regexp_extract(bare, rf"^(\d+(?:\.\d+)*){P.S}", 1)
    depth = F.regexp_count(token, F.lit(r"\."))
    return (
        F.when(is_heading & (level > 1), F.least(F.lit(72.0), (level - 1) * 12.0 + base))
        .when(token != "", F.least(F.lit(72.0), base + depth * 14.0))
        .otherwise(F.least(F.lit(48.0), base))
    )


def minor_units(cost: Column) -> Column:
    """half-even conversion to minor currency units."""
    return F.bround(F.coalesce(cost.cast("double"), F.lit(0.0)) * 100, 0).cast("int")


# milestone labels that map to themselves (fixed values)
_KNOWN_STATUSES = ("completed", "preview_ready", "failed", "processing", "awaiting_payment")


def job_status(ui_status: Column) -> Column:
    """F16: unknown labels become pending."""
    low = F.lower(blankless(ui_status))
    return F.when(low.isin(*_KNOWN_STATUSES), low).otherwise("pending")


def sanitize_output(c: Column) -> Column:
    """Echo lines, doubled page heads and blank runs in model output."""
    lines = F.split(F.regexp_replace(clean_control_chars(c), _NEWLINES, "\n"), "\n")
    echo = f"{P.ECHO_PHRASE}{P.NOT_BEFORE_WORD}{P.S}*"
    only_echo = rf"(?is)^(?:{P.S}*(?:assistant{P.S}+)?{echo}){{3,}}$"
    inline_echo = rf"(?is)(?:{P.NOT_AFTER_WORD}assistant{P.NOT_BEFORE_WORD}{P.S}*)?(?:{echo}){{2,}}"
    head = rf"^([A-Z]{{2,}}(?:{P.S}+[A-Z]{{2,}}){{0,8}}){P.S}+\1(?:{P.S}+\d{{1,4}})?$"

    def doubled_head(s: Column) -> Column:
        title = F.regexp_extract(s, head, 1)
        return F.length(F.replace(title, F.lit(" "), F.lit(""))) >= 6

    kept = F.filter(lines, lambda s: ~strip(s).rlike(only_echo) & ~doubled_head(strip(s)))
    tidy = F.transform(kept, lambda s: squash(F.regexp_replace(s, inline_echo, " ")))
    return strip(F.regexp_replace(F.array_join(tidy, "\n"), "\n{3,}", "\n\n"))


def payg_price(words: Column, per_100k: float = 99.0) -> Column:
    """B1: proportional rate, half-even to whole units."""
    w = F.greatest(F.coalesce(words.cast("long"), F.lit(0)), F.lit(0)).cast("double")
    return F.bround((w / F.lit(100000.0)) * F.lit(per_100k), 0)


def token_price(tokens: Column, minimum: float = 5.0, per_10k: float = 9.9) -> Column:
    """B2: token-based estimate with a floor, rounded up to the cent."""
    words = F.greatest(tokens.cast("double"), F.lit(0.0)) * 0.75
    due = F.greatest(F.lit(minimum), (words / 10000.0) * F.lit(per_10k))
    return F.ceil(due * 100) / F.lit(100.0)


def words_from_tokens(tokens: Column) -> Column:
    return F.greatest(F.bround(tokens.cast("double") * 0.75, 0).cast("long"), F.lit(0))



