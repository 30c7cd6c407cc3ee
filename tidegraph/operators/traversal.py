"""Further programs on the same surface: searches, components, propagation and degrees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.graph import Graph
from ..plans.program import Context, Step, VertexProgram
from ..plans.superstep import Result, run


class ShortestPaths(VertexProgram):
    """Distances from a source along edge values, or numbers of edges; infinity where there is no path."""

    combine = {"least": lambda src, value: F.min(value)}

    def __init__(self, source: int, weighted: bool = True):
        self.source, self.weighted = source, weighted

    def compute(self, ctx: Context) -> Step:
        if ctx.superstep == 0:
            start = ctx.id == self.source
            value, send = F.when(start, 0.0).otherwise(float("inf")), start
        else:
            found = F.coalesce(ctx.inbox("least"), F.lit(float("inf")))
            value, send = F.least(ctx.value, found), found < ctx.value
        length = (lambda e: e.value) if self.weighted else (lambda e: F.lit(1.0))
        return Step(value=value, halt=True, send=send, message=lambda v, e: v.value + length(e))


class Propagation(VertexProgram):
    """Every vertex takes the least (or greatest) value that reaches it along out-edges."""

    def __init__(self, most: bool = False, message_type: str = "double"):
        self.most, self.message_type = most, message_type
        self.combine = {"found": (lambda src, value: F.max(value)) if most else (lambda src, value: F.min(value))}

    def compute(self, ctx: Context) -> Step:
        if ctx.superstep == 0:
            return Step(halt=True, message=lambda v, e: v.value)
        new = (F.greatest if self.most else F.least)(ctx.value, ctx.inbox("found"))
        return Step(value=new, halt=True, send=new != ctx.value, message=lambda v, e: v.value)


class InDegree(VertexProgram):
    """The number of messages that arrive when every vertex sends one along each out-edge."""

    def compute(self, ctx: Context) -> Step:
        if ctx.superstep == 0:
            return Step(message=lambda v, e: F.lit(1.0))
        return Step(value=ctx.received.cast("double"), halt=True)


class LabelPropagation(VertexProgram):
    """Every vertex takes the label that most of its messages carry, of several the least, over so many rounds."""

    combine = {"label": lambda src, value: F.mode(value, deterministic=True)}

    def __init__(self, rounds: int, message_type: str = "double"):
        self.rounds, self.message_type = rounds, message_type

    def compute(self, ctx: Context) -> Step:
        if ctx.superstep == 0:
            return Step(message=lambda v, e: v.value)
        done = ctx.superstep >= self.rounds
        return Step(value=F.coalesce(ctx.inbox("label"), ctx.value), halt=done, message=None if done else lambda v, e: v.value)


def value_type(graph: Graph) -> str:
    """The type of a graph's values, which messages that carry values keep."""
    return graph.vertices.schema["value"].dataType.simpleString()


def label_propagation(graph: Graph, rounds: int, **options) -> Result:
    """Labels after so many rounds; each vertex starts with its value."""
    return run(graph, LabelPropagation(rounds, value_type(graph)), **options)


def bfs(graph: Graph, source: int, max_supersteps: int | None = None, **options) -> Result:
    return run(graph, ShortestPaths(source, weighted=False), max_supersteps, **options)


def shortest_paths(graph: Graph, source: int, max_supersteps: int | None = None, **options) -> Result:
    return run(graph, ShortestPaths(source), max_supersteps, **options)


def weak_components(graph: Graph, **options) -> Result:
    """The least id that a vertex is connected with, whichever way edges point."""
    both = graph.edges.unionByName(graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "value"))
    numbered = graph.vertices.select("id", F.col("id").alias("value"))
    return run(Graph(numbered, both), Propagation(message_type="bigint"), **options)


def propagate_most(graph: Graph, max_supersteps: int | None = None, **options) -> Result:
    return run(graph, Propagation(most=True, message_type=value_type(graph)), max_supersteps, **options)


def in_degrees(graph: Graph, **options) -> Result:
    return run(graph, InDegree(), **options)
