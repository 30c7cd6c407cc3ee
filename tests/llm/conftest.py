import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_helpers import DOCS, ODD  # noqa: E402


@pytest.fixture
def put(spark, tmp_path):
    """Writes tables into a folder as the queries read them."""

    def write(**tables):
        for name, frame in tables.items():
            frame.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture
def clashing(odd):
    """The odd rows with further columns that are named like the operators' own."""
    for c in ("fp", "node", "size", "_row", "_text", "_key", "key", "x", "bucket", "row", "at", "h", "plan"):
        odd = odd.withColumn(c, F.lit("clash"))
    return odd
