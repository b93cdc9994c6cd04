"""Raw-file manifests, plan manifests and table sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.config import DEFAULTS
from quirework.functions import patterns as P

# leading bytes by suffix; a text file is checked for valid UTF-8 instead (fixed values)
_MAGIC = (
    ((".pdf",), ("25504446",)),
    ((".docx", ".epub", ".ebup"), ("504B0304",)),
    ((".png",), ("89504E47",)),
    ((".jpg", ".jpeg"), ("FFD8FF",)),
    ((".gif",), ("47494638",)),
    ((".bmp",), ("424D",)),
    ((".tiff", ".tif"), ("49492A00", "4D4D002A")),
    ((".webp",), ("52494646",)),
)

MANIFEST = (
    "version int, document_template_id string, translation_target string, segments array<string>, "
    "batches array<array<int>>, items array<struct<block_pos:int,row:int,col:int,para:int,item:int,"
    "kind:string,text:string,segment_id:int>>"
)


def describe_files(files: DataFrame, max_bytes: int = DEFAULTS.max_upload_bytes) -> DataFrame:
    """S3: suffix, size, digest and verdict of rows (path, content)."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    head = F.hex(F.substring("content", 1, 4))
    known: Column = F.lit(False)
    for names, marks in _MAGIC:
        hit = F.lit(False)
        for m in marks:
            hit = hit | head.startswith(m)
        known = F.when(F.col("suffix").isin(*names), hit).otherwise(known)
    sound = F.when(F.col("suffix") == ".txt", F.is_valid_utf8(F.col("content").cast("string"))).otherwise(known)
    size = F.length("content")
    verdict = (
        F.when(~F.col("suffix").isin(*P.ALLOWED_SUFFIXES), "unsupported_type")
        .when(size == 0, "empty")
        .when(F.lit(max_bytes > 0) & (size > max_bytes), "too_large")
        .when(~sound, "corrupted").otherwise("ok")
    )
    return files.withColumn("suffix", suffix).select(
        "path", "suffix", size.cast("long").alias("bytes"), F.sha2("content", 256).alias("content_hash"), verdict.alias("verdict")
    )


def file_manifest(spark: SparkSession, path: str, max_bytes: int = DEFAULTS.max_upload_bytes) -> DataFrame:
    """S3 over a folder. Files above ``max_bytes`` are told by their length alone; their content is not read.
    Spark's scan passes over files of no bytes, so those have no row here.
    """
    files = spark.read.format("binaryFile").load(path)
    if max_bytes <= 0:
        return describe_files(files.select("path", "content"), max_bytes)
    small = describe_files(files.filter(F.col("length") <= max_bytes).select("path", "content"), max_bytes)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    large = files.filter(F.col("length") > max_bytes).select(
        "path", suffix.alias("suffix"), F.col("length").alias("bytes"), F.lit(None).cast("string").alias("content_hash"),
        F.when(~suffix.isin(*P.ALLOWED_SUFFIXES), "unsupported_type").otherwise("too_large").alias("verdict"))
    return small.unionByName(large)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Decoded page lines with their spans."""
    from quirework.schemas import LINES

    return spark.read.schema(LINES).parquet(path)


def plan_manifests(items: DataFrame, batches: DataFrame, target: str = DEFAULTS.default_target) -> DataFrame:
    """One version-2 JSON manifest per document."""
    place = ("block_pos", "row", "col", "para", "item")
    per_doc = items.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct(*place, "kind", "text", "segment_id"))).alias("items")
    )
    packs = batches.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("batch_id", "segment_ids"))).alias("b")
    )
    jobs = F.filter("items", lambda i: i["kind"] == "job")
    body = F.struct(
        F.lit(2).alias("version"), F.lit(target).alias("translation_target"),
        F.transform(F.array_sort(F.transform(jobs, lambda i: F.struct(i["segment_id"].alias("n"), i["text"].alias("t")))),
                    lambda s: s["t"]).alias("segments"),
        F.coalesce(F.col("b.segment_ids"), F.array().cast("array<array<int>>")).alias("batches"),
        F.transform("items", lambda i: F.struct(
            *[i[c].alias(c) for c in (*place, "kind")],
            F.when(i["kind"] == "skip", i["text"]).alias("text"), i["segment_id"].alias("segment_id"))).alias("items"),
    )
    return per_doc.join(packs, "doc_id", "left").select("doc_id", F.to_json(body).alias("manifest"))


def read_manifests(manifests: DataFrame) -> DataFrame:
    """Parsed manifests; any other version fails the job."""
    m = F.from_json("manifest", MANIFEST)
    parsed = manifests.select("doc_id", m.alias("m"))
    ok = F.coalesce(F.col("m.version") == 2, F.lit(False))
    checked = F.when(ok, F.col("m")).otherwise(F.raise_error("unsupported manifest version").cast(parsed.schema["m"].dataType))
    return parsed.withColumn("m", checked).select("doc_id", "m.*")


def structured_sidecars(docs: DataFrame, source: str = "path") -> DataFrame:
    """(path, document): each structured document as JSON beside its source file, as ``stem.structure.json``."""
    fields = [c for c in docs.columns if c != source]
    stem = F.regexp_replace(source, r"\.[^./\\]*$", "")
    return docs.select(F.concat(stem, F.lit(".structure.json")).alias("path"), F.to_json(F.struct(*fields)).alias("document"))


def write_structured(docs: DataFrame, path: str) -> None:
    """Structured documents as JSON, a folder per document kind."""
    docs.write.mode("overwrite").partitionBy("document_type").json(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    """Append-only ledger, a folder per month."""
    rows.withColumn("month", F.date_format("created_at", "yyyy-MM")).write.mode("append").partitionBy("month").parquet(path)
