"""PageRank with convergence: un-normalised, sinks leak their rank."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.aggregators import total
from ..plans.graph import Graph
from ..plans.program import Context, Step, VertexProgram
from ..plans.superstep import Result, run

EPSILON, DAMPING = 1e-6, 0.85


class PageRank(VertexProgram):
    """Every vertex starts at 1.0; from superstep 2 on all halt once the last sum of changes is below epsilon."""

    combine = {"sum": lambda src, value: F.sum(value)}
    summed = "sum"
    aggregators = {"change": total(0.0)}

    def __init__(self, epsilon: float = EPSILON, damping: float = DAMPING):
        self.epsilon, self.damping = epsilon, damping

    def compute(self, ctx: Context) -> Step:
        if ctx.superstep >= 2 and ctx.aggregate("change") < self.epsilon:
            return Step(halt=True)
        # Messages are made for vertices with out-edges only, so that those without any never divide.
        share = lambda v, e: v.value / v.out_degree
        if ctx.superstep == 0:
            return Step(value=F.lit(1.0), message=share)
        value = F.lit(round(1 - self.damping, 12)) + F.lit(self.damping) * F.coalesce(ctx.inbox("sum"), F.lit(0.0))
        return Step(value=value, message=share, contribute={"change": F.abs(ctx.value - value)})


def pagerank(graph: Graph, epsilon: float = EPSILON, max_supersteps: int | None = None, **options) -> Result:
    return run(graph, PageRank(epsilon), max_supersteps, **options)
