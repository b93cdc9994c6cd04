"""Small builders for the DuckDB side of the checks."""

from __future__ import annotations

from quirework.functions import patterns as P


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def cnt(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def strip(x: str) -> str:
    return sub(f"coalesce({x}, '')", f"^{P.S}+|{P.S}+$", "")


def squash(x: str) -> str:
    return f"trim({sub(f'coalesce({x}, chr(32))', P.S + '+', ' ')})"


def words(x: str) -> str:
    return cnt(x, P.WORD)


def tokens(x: str) -> str:
    return cnt(x, P.TOKEN)


def opens(p: str) -> str:
    return rf"(?i)^(?:{p})($|[^{P.WORD_CHARS}])"


def whole(p: str) -> str:
    return rf"(^|[^{P.WORD_CHARS}])(?:{p})($|[^{P.WORD_CHARS}])"


def any_of(*conds: str) -> str:
    return "(" + " OR ".join(f"({c})" for c in conds) + ")"


def all_of(*conds: str) -> str:
    return "(" + " AND ".join(f"({c})" for c in conds) + ")"


def upper_ratio(x: str) -> str:
    n = cnt(x, P.LETTER)
    return f"(CASE WHEN {n} > 0 THEN {cnt(x, P.UPPER)} / {n}::DOUBLE ELSE 0.0 END)"


LINES = f"""
lines AS (
  SELECT doc_id, pos, {strip('line')} AS text
  FROM (SELECT doc_id,
               unnest(string_split({strip('text')}, chr(10))) AS line,
               generate_subscripts(string_split({strip('text')}, chr(10)), 1) - 1 AS pos
        FROM documents)
  WHERE {has('line', P.NS)}
)"""
