"""Personal data: fixed forms, and identifiers in contexts learned from them (operator 6).

E-mail addresses, IP addresses, card and phone numbers in their fixed forms are seeds. The words
around them are lexical patterns; a graph of patterns and the strings they surround is scored to and fro,
and patterns of high confidence point to identifiers that have no fixed form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.shared import reliable

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Runs are taken whole, so that a long one is read once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TOKEN = re.compile(r"[^\s]*[0-9@][^\s]*")
_EDGES = ".,;:!?\"'()[]{}<>"
_NEAR = 64


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: the run before it, no further back than the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(d * 2 - 9 * (d > 4) for d in values[1::2])) % 10 == 0


def fixed_forms(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every seed, by kind and then by place."""
    found = [(0, s, e) for s, e in emails(text)]
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def _patterns(text: str, start: int, end: int) -> list[str]:
    """The words around a place: one before, two before, and one on each side; digits look alike."""
    before = _DIGIT.sub("0", text[max(0, start - _NEAR): start].lower()).split()[-2:]
    after = _DIGIT.sub("0", text[end: end + _NEAR].lower()).split()[:1]
    out = []
    if before:
        out.append("1 " + before[-1])
        if after:
            out.append(f"b {before[-1]} _ {after[0]}")
    if len(before) == 2:
        out.append("2 " + " ".join(before))
    return out


def _mentions(text: str, seeds: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds, and other strings with a digit or @ that overlap none of them."""
    out = [{"kind": k, "start": s, "end": e, "surface": text[s:e], "patterns": _patterns(text, s, e)} for k, s, e in seeds]
    spans = sorted((s, e) for _, s, e in seeds)
    at = 0
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        while start < end and text[start] in _EDGES:
            start += 1
        while end > start and text[end - 1] in _EDGES:
            end -= 1
        while at < len(spans) and spans[at][1] <= start:
            at += 1
        if start < end and not any(s < end and start < e for s, e in spans[at: at + len(KINDS)]):
            out.append({"kind": None, "start": start, "end": end, "surface": text[start:end], "patterns": _patterns(text, start, end)})
    return out


_MENTION = "kind int, start int, end int, surface string, patterns array<string>"
_MENTION_TYPE = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("surface", pa.string()), ("patterns", pa.list_(pa.string()))])


def mentions(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, _text (a hash of the text) and its mentions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 512):
                rows = batch.slice(start, 512)
                found = [_mentions(t, fixed_forms(t)) for t in rows.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("_text"), pa.array(found, pa.list_(_MENTION_TYPE))], ["doc_id", "_text", "mentions"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_text"))
    return rows.mapInArrow(run, f"doc_id bigint, _text bigint, mentions array<struct<{_MENTION.replace(' ', ':').replace(',:', ',')}>>")


def scored_patterns(found: DataFrame, *, rounds: int = 4, prior: float = 1.0, least_seeds: int = 3) -> DataFrame:
    """(pattern, kind, confidence) from the graph of patterns and the strings they surround.

    A pattern's confidence in a kind is the mean score of the strings that it surrounds, ``prior`` unknown ones
    added. A seed scores 1 in its kind and 0 in others; another string scores what the confidences
    of its patterns make up together (one less the product of the doubts). Patterns with fewer than
    ``least_seeds`` different strings of some score count for nothing. Every distinct edge counts once, so one
    string repeated a million times is one vote. Each round is cut by a checkpoint.
    """
    each = found.select(F.explode("mentions").alias("m")).select("m.kind", "m.surface", F.explode("m.patterns").alias("pattern"))
    edges = reliable(each.groupBy("pattern", "surface").agg(F.min("kind").alias("kind")))
    total = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    seeds = edges.filter("kind IS NOT NULL").select("pattern", "surface", "kind", F.lit(1.0).alias("score"))
    unseen = edges.filter("kind IS NULL").select("pattern", "surface")
    votes, patterns = seeds, None
    for _ in range(rounds):
        sums = votes.groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("votes")).filter(F.col("votes") >= least_seeds)
        patterns = reliable(sums.join(total, "pattern").select("pattern", "kind", (F.col("s") / (F.col("n") + prior)).alias("confidence")))
        doubt = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))
        scores = unseen.join(patterns.filter("confidence >= 0.5"), "pattern").groupBy("surface", "kind").agg((1 - F.exp(doubt)).alias("score"))
        votes = seeds.unionByName(unseen.join(scores, "surface").select("pattern", "surface", "kind", "score"))
    return patterns


def find_personal_data(docs: DataFrame, *, confidence: float = 0.8, rounds: int = 4) -> DataFrame:
    """Per row of ``docs``: doc_id, base and learned, arrays of (kind, start, end) in code points, ends exclusive.

    base holds the seeds: leftmost non-overlapping matches of each kind's form, less those that fail its check.
    learned holds strings with a digit or @, outside all seeds, next to a pattern of at least ``confidence``;
    the kind is the most confident pattern's, the earlier one of equals.

    A null text counts as empty; both arrays are then empty. Rows equal in doc_id and text get equal
    results, a null doc_id among them; other columns are ignored; an empty table gives an empty one. Long runs of
    digits or of address characters are read once.
    """
    found = reliable(mentions(docs))
    patterns = scored_patterns(found, rounds=rounds).filter(F.col("confidence") >= confidence)
    loose = found.select("doc_id", "_text", F.explode(F.filter("mentions", lambda m: m["kind"].isNull())).alias("m"))
    near = loose.select("doc_id", "_text", "m.start", "m.end", F.explode("m.patterns").alias("pattern")).distinct()
    best = near.join(patterns, "pattern").groupBy("doc_id", "_text", "start", "end").agg(
        F.max(F.struct("confidence", (-F.col("kind")).alias("kind"))).alias("b"))
    learned = best.groupBy("doc_id", "_text").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("b.kind")).alias("kind"), "start", "end"))).alias("learned"))
    base = F.transform(F.filter("mentions", lambda m: m["kind"].isNotNull()), lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    named = learned.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_own"), "learned")
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return found.select("doc_id", "_text", base.alias("base")).join(
        named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_own")), "left",
    ).select("doc_id", "base", F.coalesce("learned", none).alias("learned"))
