"""Results and partitioned graphs as text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import Graph


def result_line(id: Column, value: Column) -> Column:
    """ "id: value", value with six decimals."""
    return F.format_string("%d: %.6f", id, value)


def write_result(vertices: DataFrame, path: str, line: Column | None = None, parts: int | None = None, mode: str = "error") -> None:
    """Writes a line per vertex, ascending by id: in ranges of ids, or with parts in folders part=1..parts by id % parts."""
    line = result_line(F.col("id"), F.col("value")) if line is None else line
    if parts is None:
        vertices.repartitionByRange("id").sortWithinPartitions("id").select(line.alias("value")).write.mode(mode).text(path)
        return
    rows = vertices.select("id", line.alias("line"), part_of(F.col("id"), parts).alias("part")).repartition(parts, "part").sortWithinPartitions("part", "id")
    rows.select(F.col("line").alias("value"), "part").write.mode(mode).partitionBy("part").text(path)


def name_parts(spark: SparkSession, folder: str, prefix: str) -> None:
    """Moves the one file of each folder/part=k to PREFIX_k and removes folder; as many moves as parts. Other parts get no file."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    where = path(folder)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in files.globStatus(path(f"{folder}/part=*/part-*")) or ():
        part = found.getPath().getParent().getName().removeprefix("part=")
        target = path(f"{prefix}_{part}")
        if files.exists(target):
            raise FileExistsError(f"{prefix}_{part}")
        if not files.rename(found.getPath(), target):
            raise OSError(f"{found.getPath()} can't be moved to {target}")
    files.delete(where, True)


def write_result_parts(vertices: DataFrame, prefix: str, parts: int, line: Column | None = None) -> None:
    """Writes a line per vertex to the files PREFIX_1..PREFIX_parts, by id % parts, as parts_of(PREFIX) reads them."""
    folder = f"{prefix}-{uuid.uuid4().hex}"
    write_result(vertices, folder, line, parts)
    name_parts(vertices.sparkSession, folder, prefix)


def write_graph_parts(graph: Graph, prefix: str, parts: int, values: bool = False) -> None:
    """Writes a graph as the edge lists PREFIX_1..PREFIX_parts."""
    folder = f"{prefix}-{uuid.uuid4().hex}"
    write_partitioned(graph, folder, parts, values)
    name_parts(graph.edges.sparkSession, folder, prefix)


def part_of(id: Column, parts: int) -> Column:
    """The part of a vertex, from 1."""
    return F.pmod(id, F.lit(parts)) + 1


def partition_headers(graph: Graph, parts: int) -> DataFrame:
    """part, vertices, edges: the headers of each part. Edges belong to the part of their source."""
    spark = graph.edges.sparkSession
    total = graph.vertices.agg(F.count("*").alias("total"))
    edges = graph.edges.groupBy(part_of(F.col("src"), parts).alias("part")).agg(F.count("*").alias("edges"))
    share = F.floor(F.col("total") / parts) + F.when(F.col("part") <= F.col("total") % parts, 1).otherwise(0)
    rows = spark.range(1, parts + 1).withColumnRenamed("id", "part").join(edges, "part", "left").join(F.broadcast(total))  # one row
    return rows.select("part", share.cast("long").alias("vertices"), F.coalesce("edges", F.lit(0).cast("long")).alias("edges"))


def write_partitioned(graph: Graph, path: str, parts: int, values: bool = False, mode: str = "error") -> None:
    """Writes a graph as edge lists part=1..parts: header lines, then edges by source. values: whether edge values follow."""
    head = partition_headers(graph, parts)
    lines = head.select("part", F.lit(-2).cast("long").alias("src"), F.lit(0).cast("long").alias("dst"), F.col("vertices").cast("string").alias("value"))
    lines = lines.union(head.select("part", F.lit(-1).cast("long"), F.lit(0).cast("long"), F.col("edges").cast("string")))
    ends = [F.col("src").cast("string"), F.col("dst").cast("string")] + ([F.col("value").cast("string")] if values else [])
    lines = lines.union(graph.edges.select(part_of(F.col("src"), parts), "src", "dst", F.concat_ws(" ", *ends)))
    lines.repartition(parts, "part").sortWithinPartitions("part", "src", "dst").select("value", "part").write.mode(mode).partitionBy("part").text(path)
