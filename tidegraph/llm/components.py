"""Connected components of an edge table by alternating large and small stars.

Each round rewires neighbours to the least node they know; the number of rounds is logarithmic in practice, also for
chains. Rounds are tables of the shared folder, nothing is collected but a count and a checksum, and a hub's neighbours are
never gathered: minima are aggregated in parts, and nodes with more than 1/HUBS of all rows, which are HUBS at most, get
theirs from a broadcast table while the rest is joined by shuffling. FEW edges or fewer need no rounds: the driver finds their
components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch, few, join_unique


def _large(edges: DataFrame, count: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("m", "u").alias("m"), "n")
    return join_unique(both.where("v > u"), least, "u", 2 * count).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame, count: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return join_unique(down, least, "u", count).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def _settle(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, tuple]:
    """edges as a table of scratch, their number and a checksum, in one job."""
    seen = Observation()
    made = scratch.settle(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "edges")
    found = seen.get
    return made, (found["n"], found["sum"])


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges, sorted, and of each the least that it reaches: roots hang on the least neighbour until all edges are inside."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    up = np.arange(len(nodes))
    while (up[a] != up[b]).any():
        np.minimum.at(up, np.maximum(up[a], up[b]), np.minimum(up[a], up[b]))
        while (up != up[up]).any():
            up = up[up]
    return nodes, nodes[up]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root for every node of edges u, v (no nulls; loops and repeated edges are fine): root is the least node of its component.

    The result is read from a table, the last round's if there were rounds, which scratch holds.
    """
    own = Scratch(edges.sparkSession)
    now, mark = _settle(edges.where("u != v").select("u", "v").distinct(), own)
    if few(mark[0]):
        found = now.toArrow()
        made = least_reachable(*(np.array(found[c].to_numpy(), np.int64) for c in ("u", "v")))
        roots = edges.sparkSession.createDataFrame(pa.table([pa.array(x, pa.int64()) for x in made], ["node", "root"]))
        own.clear()
        return scratch.settle(roots.coalesce(1), "roots")
    while mark[0]:
        after, seen = Scratch(edges.sparkSession), mark
        now, mark = _settle(_small(_large(now, mark[0]), mark[0]).where("u != v").distinct(), after)
        own.clear()
        own = after
        if mark == seen:
            break
    scratch.paths += own.paths
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
