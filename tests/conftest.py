from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def blocks(spark):
    """Rows of dicts to a block table of one or more documents."""
    schema = (
        "doc_id bigint, pos int, type string, text string, level int, structural_tag string, list_kind string, "
        "source_page int, action string, semantic_role string"
    )
    defaults = {"doc_id": 1, "type": "paragraph", "level": 1, "action": "TRANSLATE"}

    def make(rows: list[dict]):
        names = [f.split()[0] for f in schema.split(", ")]
        filled = [{**defaults, "pos": i, **r} for i, r in enumerate(rows)]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in filled], schema)

    return make


def column(df, name: str) -> list:
    return [r[name] for r in df.orderBy("doc_id", "pos").collect()]
