"""A directed graph as two frames: vertices (id, value) and edges (src, dst, value)."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Graph:
    """Vertices exist because the vertex frame has them; edges may be parallel and each counts.

    Schemas are checked when the graph is made: id, src and dst are BIGINT, value may be any type of Spark.
    """

    def __init__(self, vertices: DataFrame, edges: DataFrame):
        for frame, columns in ((vertices, ("id",)), (edges, ("src", "dst"))):
            for c in columns:
                if c not in frame.columns or not isinstance(frame.schema[c].dataType, T.LongType):
                    raise TypeError(f"column {c} must be there and BIGINT: {frame.schema.simpleString()}")
        if "value" not in vertices.columns:
            raise TypeError("vertices need a column value")
        if "value" not in edges.columns:
            edges = edges.withColumn("value", F.lit(0.0))
        self.vertices = vertices.select("id", "value")
        self.edges = edges.select("src", "dst", "value")

    @classmethod
    def dense(cls, edges: DataFrame, count: int, init: Any = 0.0, zero: Any = 0.0) -> Graph:
        """Vertices 0..count-1. Those with out-edges start with init, the others with zero, as loaders that follow the edges leave them."""
        if not isinstance(init, Column) and not isinstance(zero, Column) and init == zero:
            return cls(edges.sparkSession.range(count).select("id", F.lit(init).alias("value")), edges)
        return cls(dense_vertices(edges, count, init, zero).select("id", "value"), edges)

    def out_degrees(self) -> DataFrame:
        """id, out_degree of the vertices that have out-edges."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))

    def initial_state(self, degrees: DataFrame | None = None) -> DataFrame:
        """id, active, out_degree, value: every vertex is active at first. degrees: what out_degrees() gives, if it is known."""
        degree = F.coalesce("out_degree", F.lit(0).cast("long")).alias("out_degree")
        return self.vertices.join(self.out_degrees() if degrees is None else degrees, "id", "left").select("id", F.lit(True).alias("active"), degree, "value")


def dense_vertices(edges: DataFrame, count: int, init: Any = 0.0, zero: Any = 0.0) -> DataFrame:
    """id, active, out_degree, value of the vertices 0..count-1."""
    degrees = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    rows = edges.sparkSession.range(count).join(degrees, "id", "left")
    degree = F.coalesce("out_degree", F.lit(0).cast("long"))
    return rows.select("id", F.lit(True).alias("active"), degree.alias("out_degree"), F.when(degree > 0, as_column(init)).otherwise(as_column(zero)).alias("value"))
