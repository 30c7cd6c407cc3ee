"""Edge lists in text: per file the number of vertices, the number of edges, then a line "src dst [value]" per edge."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import Graph


class HeaderMismatch(ValueError):
    """Files hold another number of edges than their headers say, or a vertex that the headers don't count."""


def parts_of(prefix: str) -> str:
    """The files PREFIX_1, PREFIX_2, ... as a glob; any Hadoop URI will do."""
    return f"{prefix}_[0-9]*"


def edge_columns(line: Column, weight: int | None = None) -> list[Column]:
    """src, dst, value of an edge line; weight is the position of a value column from 0, other columns are ignored."""
    words = F.split(F.trim(line), r"\s+")
    value = F.lit(0.0) if weight is None else F.get(words, F.lit(weight)).cast("double")
    return [F.get(words, F.lit(0)).cast("long").alias("src"), F.get(words, F.lit(1)).cast("long").alias("dst"), value.alias("value")]


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return lines.where(F.trim("value") != "").withColumn("words", F.size(F.split(F.trim("value"), r"\s+")))


def read_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, vertices, edges: the two lines of one number at the head of each file."""
    numbers = _lines(spark, paths).where("words = 1 AND block = 0").withColumn("number", F.trim("value").cast("long"))
    return numbers.groupBy("file").agg(F.min_by("number", "line").alias("vertices"), F.max_by("number", "line").alias("edges"))


def read_edges(spark: SparkSession, paths: str | list[str], weight: int | None = None) -> DataFrame:
    """src, dst, value of all edge lines, in no order; parallel edges stay."""
    return _lines(spark, paths).where("words > 1").select(*edge_columns(F.col("value"), weight))


def load_edge_list(spark: SparkSession, paths: str | list[str], weight: int | None = None, init: Any = 0.0, zero: Any = 0.0, check: bool = True) -> Graph:
    """A graph of the vertices 0..V-1, V being the sum of the headers. Vertices without out-edges start with zero, others with init.

    check: whether edges are counted and compared with the headers, and their ends with V.
    """
    heads = read_headers(spark, paths).agg(F.sum("vertices").alias("v"), F.sum("edges").alias("e")).first()
    vertices, said = heads["v"] or 0, heads["e"] or 0
    edges = read_edges(spark, paths, weight)
    if check:
        row = edges.agg(F.count("*").alias("n"), F.max(F.greatest("src", "dst")).alias("top"), F.min(F.least("src", "dst")).alias("low")).first()
        if row["n"] != said:
            raise HeaderMismatch(f"headers count {said} edges, there are {row['n']}")
        if row["n"] and (row["top"] >= vertices or row["low"] < 0):
            raise HeaderMismatch(f"edges go beyond the {vertices} vertices that headers count: {row['low']}..{row['top']}")
    return Graph.dense(edges, vertices, init, zero)
