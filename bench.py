"""Times the headline queries on one machine and prints one JSON line.

One small query warms the JVM; each query is then timed once, planning included, into
the no-op sink, so every row and column is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from quirework.plans import load_queries

HEADLINE = (
    "corpus_quote", "doc_words", "line_flags", "sentence_budget", "repeated_lines", "preview_truncate", "contents_regions",
    "section_actions", "heading_confidence", "merged_shards", "overlap_pairs", "pack_by_tokens", "memory_lookup",
    "settle_batch", "charge_split", "latency_summary", "stage_report", "progress_monotone", "webhook_keys", "claim_outcomes",
    "template_blocks", "chapter_views", "structured_documents", "book_actions", "near_duplicates_removed", "plan_items",
    "model_calls", "unique_anchors",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC").config("quirework.scan.tasks", cpus).getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    registry = load_queries()
    registry["doc_words"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
