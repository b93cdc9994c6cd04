"""Text corpora to ordered blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions import patterns as P
from quirework.functions import text as T

BLANK_LINES = rf"\n{P.S}*\n+"


def _bullet(s: Column) -> Column:
    return T.is_list_line(s)


def text_blocks(
    docs: DataFrame, sep: str = BLANK_LINES, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Chunks of a text become list blocks (every line bulleted) or paragraphs.

    Runs inside the row that holds the text: no shuffle, and a document is never
    larger than the cell it was read from.
    """
    chunks = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.posexplode(F.split(T.strip(F.col(text)), sep)).alias("pos", "_chunk_text"),
    )
    lines = F.filter(F.split("_chunk_text", r"\r\n|[\n\r]"), lambda s: s.rlike(P.NS))
    typed = chunks.withColumn("_lines", lines).filter(F.size("_lines") > 0)
    is_list = F.forall("_lines", _bullet)
    ordered = F.forall("_lines", T.is_ordered_line)
    bare = F.transform(
        "_lines",
        lambda s: F.regexp_replace(
            F.regexp_replace(T.strip(s), rf"^\d+[.)]{P.S}+", ""), rf"^[-*•]{P.S}+", ""
        ),
    )
    return typed.select(
        "doc_id",
        "pos",
        F.when(is_list, "list").otherwise("paragraph").alias("type"),
        F.when(is_list, F.array_join(bare, "\n")).otherwise(T.strip(F.col("_chunk_text"))).alias("text"),
        F.when(is_list & ordered, "ordered").when(is_list, "bullet").alias("list_kind"),
    )


def text_lines(text: Column) -> Column:
    """The texts of ``line_blocks`` by number, for texts without bulleted lines; a line without text is an empty string."""
    return F.transform(F.split(T.strip(text), "\n"), T.strip)


def line_blocks(docs: DataFrame) -> DataFrame:
    """S1 with every line as its own block."""
    return text_blocks(docs, sep="\n")
