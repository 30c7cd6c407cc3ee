"""Graphs in the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_of(spark: SparkSession, sf_dir: str, name: str) -> int:
    return table(spark, sf_dir, name).count()


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: a part and the next one in the same order; parallel edges stay."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    return rows.select(F.col("l_partkey").alias("src"), following.alias("dst")).where("dst IS NOT NULL").withColumn("value", F.lit(0.0))


def part_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.dense(part_edges(spark, sf_dir), size_of(spark, sf_dir, "part"))


def weighted_part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, value: parallel edges as one, value their number."""
    return part_edges(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").cast("double").alias("value"))


def supply_edges(spark: SparkSession, sf_dir: str, suppliers: int) -> DataFrame:
    """src, dst: a supplier and a part it supplies; parts are numbered after the suppliers."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + suppliers).alias("dst"))
    return rows.distinct().withColumn("value", F.lit(0.0))


def supply_graph(spark: SparkSession, sf_dir: str) -> Graph:
    suppliers = size_of(spark, sf_dir, "supplier")
    return Graph.dense(supply_edges(spark, sf_dir, suppliers), suppliers + size_of(spark, sf_dir, "part"))


def user_edges(spark: SparkSession, sf_dir: str, span: str = "hour") -> DataFrame:
    """src, dst: the users of two events that follow each other by (ts, event_id).

    The order is over all events: within spans of time it is a window each, and a span's last event meets the first of the
    next through a table of a row per span.
    """
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.date_trunc(span, "ts").alias("span"))
    order = F.struct("ts", "event_id", "user_id")
    first = rows.groupBy("span").agg(F.min(order).alias("head"))
    # A row per span is ordered as one; their number grows with the time covered, not with the events.
    later = first.select("span", F.lead("head").over(Window.orderBy("span")).alias("head"))
    inside = rows.select("user_id", "span", F.lead("user_id").over(Window.partitionBy("span").orderBy("ts", "event_id", "user_id")).alias("next"))
    edges = inside.join(later, "span").select(F.col("user_id").alias("src"), F.coalesce("next", F.col("head.user_id")).alias("dst"))
    return edges.where("dst IS NOT NULL").withColumn("value", F.lit(0.0))


def user_graph(spark: SparkSession, sf_dir: str) -> Graph:
    users = table(spark, sf_dir, "events").agg(F.max("user_id")).first()[0] + 1
    return Graph.dense(user_edges(spark, sf_dir), users)


def tree_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """region -> nation -> customer and supplier, numbered in this order."""
    sizes = [size_of(spark, sf_dir, t) for t in ("region", "nation", "customer")]
    nation, customer, supplier = sizes[0], sizes[0] + sizes[1], sum(sizes)
    edge = lambda t, src, first, dst, second: table(spark, sf_dir, t).select((F.col(src).cast("long") + first).alias("src"), (F.col(dst).cast("long") + second).alias("dst"))
    edges = edge("nation", "n_regionkey", 0, "n_nationkey", nation).union(edge("customer", "c_nationkey", nation, "c_custkey", customer)).union(edge("supplier", "s_nationkey", nation, "s_suppkey", supplier))
    return Graph.dense(edges.withColumn("value", F.lit(0.0)), supplier + size_of(spark, sf_dir, "supplier"))
