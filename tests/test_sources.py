"""Scans and sinks on real files, and the row removal of the integrity checks."""

from __future__ import annotations

import datetime

from quirework.operators import quality as Q
from quirework.schemas import LINES
from quirework.sources import files


def test_file_manifest_reads_no_large_content(spark, tmp_path):
    for name, body in (("a.txt", b"plain text"), ("b.txt", b"\xff\xfe\xfa"), ("c.pdf", b"%PDF-1.7"), ("d.exe", b"MZ"), ("e.txt", b""), ("f.txt", b"x" * 5000), ("g.exe", b"y" * 5000)):
        (tmp_path / name).write_bytes(body)
    got = {r.path.rsplit("/", 1)[1]: (r.verdict, r.bytes, r.content_hash is None) for r in files.file_manifest(spark, str(tmp_path), max_bytes=1000).collect()}
    assert got == {
        "a.txt": ("ok", 10, False), "b.txt": ("corrupted", 3, False), "c.pdf": ("ok", 8, False), "d.exe": ("unsupported_type", 2, False),
        "f.txt": ("too_large", 5000, True), "g.exe": ("unsupported_type", 5000, True)}


def test_lines_documents_and_ledger_round_trip(spark, tmp_path):
    lines = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 9.0, 9.0, [("t", 11.0, "Serif", 0)])], LINES)
    lines.write.parquet(str(tmp_path / "lines"))
    assert files.read_lines(spark, str(tmp_path / "lines")).collect() == lines.collect()
    docs = spark.createDataFrame([(1, "book", "t"), (2, "notes", "u")], "doc_id bigint, document_type string, title string")
    files.write_structured(docs, str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).select("doc_id", "document_type", "title").exceptAll(docs).count() == 0
    day = datetime.datetime(2024, 5, 3)
    rows = spark.createDataFrame([(1, "k", day)], "user_id bigint, idempotency_key string, created_at timestamp")
    files.append_ledger(rows, str(tmp_path / "ledger"))
    files.append_ledger(rows, str(tmp_path / "ledger"))
    back = spark.read.parquet(str(tmp_path / "ledger"))
    assert back.count() == 2 and {str(r.month) for r in back.select("month").collect()} == {"2024-05"}


def test_self_attributions_go(spark):
    df = spark.createDataFrame([(1, 2), (3, 3)], "referrer_user_id bigint, referee_user_id bigint")
    assert [(r[0], r[1]) for r in Q.drop_self_attributions(df).collect()] == [(1, 2)]
