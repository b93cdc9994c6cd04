"""A training corpus from raw documents: reject, cut repeats, drop near copies, mix, encode.

Each stage takes all that its predecessor kept and returns the columns of ``documents``; the last one
returns the encoded rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import quality
from quirework.llm.line_dedup import remove_repeated_windows
from quirework.llm.mixing import in_mixed_order, mix_sources
from quirework.llm.ngram_join import jaccard_join
from quirework.llm.queries import encoded
from quirework.llm.shared import light, partitions, shared_folder
from quirework.plans.registry import Query

#: Where the mixture's weights by source stand in the metadata of the column ``source``.
MIXTURE = "mixture_weights"


def _carried(docs: DataFrame, *names: str) -> DataFrame:
    """The input's columns as one struct ``row``, so that no name of theirs meets one of an operator's, and the named ones beside it."""
    return docs.select(F.struct("*").alias("row"), *names)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents with a quality score of 0.7 or more.

    Null and empty texts score as an empty text, repeated rows alike; null doc_ids are scored but never learned from. An empty table gives
    an empty one; columns pass through whatever their names.
    """
    network = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(_carried(docs, "text"), network).filter("score >= 0.7").select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: repeated three-line windows go; so does a document of which nothing else is left.

    Null and empty texts stay as they are, a null doc_id comes first among the occurrences, and rows equal in doc_id and text are
    cut alike. n_chars is the length of what is left (null for a null text). An empty table gives an empty one; columns pass through whatever their names.
    """
    left = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    out = remove_repeated_windows(_carried(docs, "doc_id", "text")).filter((F.col("n_removed") == 0) | left)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of rows that links of similarity 0.8 connect, one of the smallest doc_id stays; null doc_ids all do.

    Rows are told apart by doc_id and text (128 bits of its hashes), so that different texts of one doc_id are not taken for copies of each other.
    Of rows equal in both one stays, the first by its other columns. Null and empty texts are no copies of anything but of rows of their own doc_id. An
    empty table gives an empty one; columns pass through whatever their names.
    """
    work = _carried(docs, "doc_id", "text").withColumn("key", F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text")))
    keys = work.filter("doc_id IS NOT NULL").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("rows"))
    # Numbers that rise with doc_id: the smallest one of a component is a row of its smallest doc_id.
    ranged = keys.repartitionByRange(partitions(spark), "doc_id", "key").sortWithinPartitions("doc_id", "key")
    keys = light(ranged.withColumn("nth", F.monotonically_increasing_id()))
    rows = work.join(keys, ["doc_id", "key"])
    found = jaccard_join(rows.select(F.col("nth").alias("doc_id"), "text"), n=5, num=80, den=100)[0]
    stay = light(found.filter("doc_id = component_id").select(F.col("doc_id").alias("nth")).distinct())
    kept = rows.join(stay, "nth", "left_semi")
    once = kept.filter("rows > 1").groupBy("nth").agg(F.min("row").alias("row"))
    return docs.filter("doc_id IS NULL").unionByName(kept.filter("rows = 1").select("row.*")).unionByName(once.select("row.*"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: rows in the order of the mixture, sources to the square root of their rows.

    Every row stays, repeated ones too; a null source is the source "", null doc_ids are ordered by their texts. An empty table gives
    an empty one; columns pass through whatever their names. The weights that the mixture was made with go on as metadata of ``source``,
    which Parquet keeps.
    """
    mixed = mix_sources(_carried(docs, "doc_id", "source", "text"))
    weights = mixed.schema["_position"].metadata["weights"]
    out = in_mixed_order(mixed).select("row.*")
    return out.withMetadata("source", out.schema["source"].metadata | {MIXTURE: weights})


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: token counts and digests of the ids and of what they decode to, and the row's position in the mixture.

    A position follows from the rows and the weights that the mixture handed on, not from the order in files. Rows that come from no
    mixture are weighed as it would; a source that it did not know is an error. Null and empty texts have
    no ids, a null doc_id stays null, repeated rows have a row each. An empty table gives an empty one; other columns are ignored.
    """
    weights = docs.schema["source"].metadata.get(MIXTURE)
    placed = mix_sources(docs.select("doc_id", "source", "text"), weights).withColumn("position", F.col("_position").cast("long"))
    return encoded(placed, carry=("position",))


STAGES = [
    ("quality", keep_good),
    ("line dedup", cut_repeats),
    ("near copies", drop_near_copies),
    ("mixture", mix),
    ("byte BPE", encode),
]

#: Networks, components and merges are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet into the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    *before, (_, last) = STAGES
    for k, (_, stage) in enumerate(before):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return last(spark, docs, sf_dir)


QUERY = Query("pipeline", run, ORACLE_SQL, "8, 10, 3, 4, 7")
