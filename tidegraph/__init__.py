"""Bulk-synchronous, vertex-centric graph analytics on Spark DataFrames."""

from .functions.aggregators import Aggregator, FoldAggregator, avg, count, maximum, minimum, total
from .plans.graph import Graph
from .plans.program import PandasVertexProgram, Step, VertexProgram
from .plans.superstep import Result, run
from .sources.edge_list import load_edge_list
from .sources.sinks import write_partitioned, write_result

__all__ = [
    "Aggregator",
    "FoldAggregator",
    "Graph",
    "PandasVertexProgram",
    "Result",
    "Step",
    "VertexProgram",
    "avg",
    "count",
    "load_edge_list",
    "maximum",
    "minimum",
    "run",
    "total",
    "write_partitioned",
    "write_result",
]
