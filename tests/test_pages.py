"""Points in rectangles over grids of several widths."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quirework.operators import pages as PG

LINE = "doc_id string, page int, line_no int, x0 double, y0 double, x1 double, y1 double"
BOX = "doc_id string, page int, x0 double, y0 double, x1 double, y1 double"


def test_centres_in_boxes_of_any_size(spark):
    draw = random.Random(2)
    lines = [(f"d{draw.randrange(3)}", draw.randrange(3), i, x := draw.uniform(-200, 800), y := draw.uniform(-50, 900), x + 40, y + 10) for i in range(600)]
    lines += [("d0", 0, 1000, None, 1.0, 2.0, 3.0), ("d9", 0, 1001, 1.0, 1.0, 2.0, 2.0), ("d0", 0, 1002, 5e20, 5.0, 5e20, 5.0)]
    boxes = []
    for _ in range(80):
        x, y, w, h = draw.uniform(-200, 800), draw.uniform(-50, 900), draw.choice([0, 3, 60, 700, 1e6]), draw.choice([0, 5, 90, 2000])
        boxes.append((f"d{draw.randrange(3)}", draw.randrange(3), x, y, x + w, y + h))
    boxes += [("d0", 0, 10.0, 10.0, 5.0, 5.0), ("d0", 0, 4e20, 0.0, 6e20, 9.0), ("d0", 1, None, 0.0, 1.0, 1.0), ("d1", 1, float("-inf"), 100.0, float("inf"), 140.0)]
    inside = lambda n, b: None not in (*n, *b) and b[0] == n[0] and b[1] == n[1] and b[2] <= (n[3] + n[5]) / 2 <= b[4] and b[3] <= (n[4] + n[6]) / 2 <= b[5]
    want = sorted(n[2] for n in lines if not any(inside(n, b) for b in boxes))
    out = PG.outside_tables(spark.createDataFrame(lines, LINE), spark.createDataFrame(boxes, BOX))
    assert sorted(r.line_no for r in out.collect()) == want and 0 < len(want) < len(lines)


def test_a_page_with_many_lines_and_boxes(spark):
    """Ten thousand of both on one page: each line meets the boxes of its cell only."""
    n = 10_000
    at = spark.range(n).select(F.lit("d").alias("doc_id"), F.lit(1).alias("page"), F.col("id").cast("int").alias("line_no"), (F.col("id") % 100 * 10.0).alias("x0"), (F.floor(F.col("id") / 100) * 10.0).alias("y0"))
    lines = at.select("*", (F.col("x0") + 4).alias("x1"), (F.col("y0") + 4).alias("y1"))
    boxes = at.filter("line_no % 2 = 0").select("doc_id", "page", "x0", "y0", (F.col("x0") + 5).alias("x1"), (F.col("y0") + 5).alias("y1"))
    boxes = boxes.unionByName(boxes)
    assert PG.outside_tables(lines, boxes).agg(F.count(F.lit(1)), F.min(F.col("line_no") % 2)).first() == (n // 2, 1)
