"""Edge lists that arrive as a stream of files; supersteps themselves are batch jobs over what has arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.edge_list import edge_columns


def stream_edges(spark: SparkSession, folder: str, weight: int | None = None) -> DataFrame:
    """src, dst, value of the edge lines of files as they arrive; header lines are passed over."""
    lines = spark.readStream.text(folder).where(F.size(F.split(F.trim("value"), r"\s+")) > 1)
    return lines.select(*edge_columns(F.col("value"), weight))


def running_out_degree(edges: DataFrame) -> DataFrame:
    """id, out_degree so far; for output mode update or complete."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
