"""Graph jobs from a shell: python -m tidegraph COMMAND --input PATHS --output PATH [--parts N [--prefix]].

Commands: pagerank, bfs, sssp, components, labels, max, in-degree, partition, and run MODULE:PROGRAM for a program of the user's, a
subclass of VertexProgram or PandasVertexProgram on the Python path, made with the given --args.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .operators.pagerank import EPSILON, pagerank
from .operators.traversal import bfs, in_degrees, label_propagation, propagate_most, shortest_paths, weak_components
from .plans.graph import Graph
from .plans.superstep import Result, run
from .sources.edge_list import load_edge_list
from .sources.sinks import result_line, write_graph_parts, write_partitioned, write_result, write_result_parts


def numbered(graph: Graph) -> Graph:
    """The graph with ids as values."""
    return Graph(graph.vertices.select("id", F.col("id").alias("value")), graph.edges)


def program_of(name: str, args: list[str]):
    module, _, made = name.partition(":")
    if "" not in sys.path:
        sys.path.insert(0, "")
    return getattr(importlib.import_module(module), made)(*args)


COMMANDS = {
    "pagerank": lambda graph, said: pagerank(graph, said.epsilon, said.max_supersteps),
    "bfs": lambda graph, said: bfs(graph, said.source, said.max_supersteps),
    "sssp": lambda graph, said: shortest_paths(graph, said.source, said.max_supersteps),
    "components": lambda graph, said: weak_components(graph, max_supersteps=said.max_supersteps),
    "labels": lambda graph, said: label_propagation(numbered(graph), said.rounds),
    "max": lambda graph, said: propagate_most(numbered(graph), said.max_supersteps),
    "in-degree": lambda graph, said: in_degrees(graph),
    "run": lambda graph, said: run(graph, program_of(said.program, said.args), said.max_supersteps),
}


def line_of(result: Result) -> Column:
    """Numbers with a fraction as "id: value" with six decimals, all else as it reads."""
    kind = result.vertices.schema["value"].dataType.simpleString()
    if kind in ("double", "float"):
        return result_line(F.col("id"), F.col("value"))
    return F.concat_ws(": ", F.col("id").cast("string"), F.to_json("value") if kind.startswith(("array", "map", "struct")) else F.col("value").cast("string"))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidegraph", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in (*COMMANDS, "partition"):
        command = commands.add_parser(name)
        if name == "run":
            command.add_argument("program", help="MODULE:PROGRAM")
            command.add_argument("--args", nargs="*", default=[], help="strings that the program is made with")
        if name == "pagerank":
            command.add_argument("--epsilon", type=float, default=EPSILON)
        if name in ("bfs", "sssp"):
            command.add_argument("--source", type=int, required=True)
        if name == "labels":
            command.add_argument("--rounds", type=int, default=10)
        command.add_argument("--input", nargs="+", required=True, help="files or globs of any Hadoop file system")
        command.add_argument("--output", required=True)
        command.add_argument("--parts", type=int, required=name == "partition")
        command.add_argument("--prefix", action="store_true", help="write the files OUTPUT_1, OUTPUT_2, ...; needs --parts")
        command.add_argument("--weight", type=int, help="position of edge values in a line, from 0")
        command.add_argument("--max-supersteps", type=int)
        command.add_argument("--scratch", help="a folder that the driver and all executors share, where spark.checkpoint.dir is unset")
    said = parser.parse_args(args)
    if said.prefix and said.parts is None:
        parser.error("--prefix needs --parts")
    spark = SparkSession.builder.appName("tidegraph").getOrCreate()
    if said.scratch:
        spark.sparkContext.setCheckpointDir(said.scratch)
    graph = load_edge_list(spark, said.input, said.weight)
    if said.command == "partition":
        (write_graph_parts if said.prefix else write_partitioned)(graph, said.output, said.parts, said.weight is not None)
        return 0
    result = COMMANDS[said.command](graph, said)
    if said.prefix:
        write_result_parts(result.vertices, said.output, said.parts, line_of(result))
    else:
        write_result(result.vertices, said.output, line_of(result), said.parts)
    print(f"{result.supersteps} supersteps, {sum(r['sent'] for r in result.report)} messages, {result.seconds:.3f} s, stopped by {result.stopped_by}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
