"""Marked-up pages to ordered blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quirework.operators.merging import merge_adjacent
from quirework.operators.rows import sliced

_SCHEMA = "doc_id bigint, pos int, type string, text string, data array<array<string>>, level int"
_ROWS = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("type", pa.string()), ("text", pa.string()),
                   ("data", pa.list_(pa.list_(pa.string()))), ("level", pa.int32())])
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_TEXT_TAGS = {"h1", "h2", "h3", "h4", "h5", "h6", "p"}


def _page_blocks(html: str) -> list[tuple]:
    """Headings, paragraphs and tables of one page in document order."""
    from html.parser import HTMLParser

    found: list[dict] = []

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open: list[tuple[str, dict | None]] = []

        def handle_starttag(self, tag, attrs):
            node = None
            if tag in _TEXT_TAGS:
                node = {"tag": tag, "texts": []}
                found.append(node)
            elif tag == "table":
                node = {"tag": tag, "rows": []}
                found.append(node)
            elif tag == "tr":
                for t, n in self.open:
                    if t == "table":
                        n["rows"].append([])
            elif tag in ("td", "th"):
                node = {"tag": tag, "texts": []}
                for t, n in self.open:
                    if t == "table" and n["rows"]:
                        n["rows"][-1].append(node)
            if tag not in _VOID:
                self.open.append((tag, node))

        def handle_endtag(self, tag):
            if any(t == tag for t, _ in self.open):
                while self.open.pop()[0] != tag:
                    pass

        def handle_data(self, data):
            if self.open and self.open[-1][0] in ("script", "style", "template"):
                return
            for _, node in self.open:
                if node and "texts" in node:
                    node["texts"].append(data)

    reader = Reader()
    reader.feed(html or "")
    reader.close()

    def text_of(node: dict) -> str:
        return " ".join(" ".join(node["texts"]).split())

    out = []
    for node in found:
        if node["tag"] == "table":
            rows = [r for r in ([text_of(c) for c in row] for row in node["rows"]) if any(r)]
            if rows:
                out.append(("table", None, rows, 1))
        elif text := text_of(node):
            heading = node["tag"] != "p"
            out.append(("heading" if heading else "paragraph", text, None, int(node["tag"][1]) if heading else 1))
    return out


def html_blocks(pages: DataFrame, doc_id: str = "page_id", html: str = "html", merge: int = 3) -> DataFrame:
    """h1-h6, p and table elements, then neighbouring paragraphs merged (Q2)."""

    def parse(doc: int, page: str | None) -> Iterator[tuple]:
        return ((doc, pos, *block) for pos, block in enumerate(_page_blocks(page)))

    named = pages.selectExpr(f"{doc_id} AS doc_id", f"{html} AS html")
    raw = named.mapInArrow(sliced(parse, named.columns, _ROWS), _SCHEMA)
    return merge_adjacent(raw, merge) if merge > 1 else raw
