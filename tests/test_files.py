"""Edge lists, results and streams of text."""

import shutil
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from tidegraph import Graph, load_edge_list, write_partitioned, write_result
from tidegraph.__main__ import main
from tidegraph.functions.shared import shared_folder
from tidegraph.sources.edge_list import HeaderMismatch, parts_of, read_headers
from tidegraph.streaming.edges import running_out_degree, stream_edges


def put(path: Path, text: str) -> str:
    path.write_text(text)
    return str(path)


def pairs(graph):
    return sorted((r["src"], r["dst"], r["value"]) for r in graph.edges.collect())


def test_parts_with_headers_weights_and_no_last_line_end(spark, tmp_path):
    put(tmp_path / "g_1", "2\n2\n0 1 0.5\n2 0 1.5")
    put(tmp_path / "g_2", "1\n1\n1 2 2.5\n")
    graph = load_edge_list(spark, parts_of(str(tmp_path / "g")), weight=2, init=1.0)
    assert graph.vertices.count() == 3 and pairs(graph) == [(0, 1, 0.5), (1, 2, 2.5), (2, 0, 1.5)]
    assert sorted(r["vertices"] for r in read_headers(spark, f"{tmp_path}/g_*").collect()) == [1, 2]
    assert [v for _, _, v in pairs(load_edge_list(spark, f"{tmp_path}/g_*"))] == [0.0] * 3


def test_vertices_without_edges_come_from_the_header(spark, tmp_path):
    graph = load_edge_list(spark, put(tmp_path / "g", "4\n1\n0 3\n"))
    assert sorted(r["id"] for r in graph.vertices.collect()) == [0, 1, 2, 3]


def test_wrong_headers_are_errors(spark, tmp_path):
    with pytest.raises(HeaderMismatch):
        load_edge_list(spark, put(tmp_path / "a", "2\n3\n0 1\n"))
    with pytest.raises(HeaderMismatch):
        load_edge_list(spark, put(tmp_path / "b", "2\n1\n0 7\n"))
    assert load_edge_list(spark, str(tmp_path / "a"), check=False).edges.count() == 1


def test_partitioned_graphs_read_back(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, 1.0), (0, 1, 1.0), (4, 2, 3.0), (3, 0, 2.0)], "src long, dst long, value double")
    write_partitioned(Graph.dense(edges, 6), f"{tmp_path}/out", 4, values=True)
    lines = {p.parent.name: p.read_text().split("\n")[:-1] for p in Path(f"{tmp_path}/out").glob("part=*/part-*")}
    assert lines == {"part=1": ["2", "3", "0 1 1.0", "0 1 1.0", "4 2 3.0"], "part=2": ["2", "0"], "part=3": ["1", "0"], "part=4": ["1", "1", "3 0 2.0"]}
    assert pairs(load_edge_list(spark, f"{tmp_path}/out/part=*", weight=2)) == sorted(tuple(r) for r in edges.collect())


def test_result_lines(spark, tmp_path):
    rows = spark.createDataFrame([(2, 0.5), (0, 1.0), (1, 2.25)], "id long, value double")
    write_result(rows, f"{tmp_path}/a")
    assert [x for p in sorted(Path(f"{tmp_path}/a").glob("part-*")) for x in p.read_text().split("\n")[:-1]] == ["0: 1.000000", "1: 2.250000", "2: 0.500000"]
    write_result(rows, f"{tmp_path}/b", parts=2)
    assert {p.parent.name: p.read_text() for p in Path(f"{tmp_path}/b").glob("part=*/part-*")} == {"part=1": "0: 1.000000\n2: 0.500000\n", "part=2": "1: 2.250000\n"}


def test_command_line(spark, tmp_path, capsys):
    put(tmp_path / "g", "2\n2\n0 1\n1 0\n")
    assert main(["pagerank", "--input", str(tmp_path / "g"), "--output", f"{tmp_path}/out", "--parts", "1"]) == 0
    assert "stopped by quiescence" in capsys.readouterr().out
    assert spark.read.text(f"{tmp_path}/out/part=1").count() == 2
    assert main(["partition", "--input", str(tmp_path / "g"), "--output", f"{tmp_path}/parts", "--parts", "2"]) == 0


def test_edges_arrive_as_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder / "a", "2\n2\n0 1\n0 2\n")
    query = running_out_degree(stream_edges(spark, str(folder))).writeStream.outputMode("complete").format("memory").queryName("degrees").start()
    try:
        query.processAllAvailable()
        put(folder / "b", "1\n1\n0 1\n")
        query.processAllAvailable()
        assert [tuple(r) for r in spark.table("degrees").collect()] == [(0, 3)]
    finally:
        query.stop()


PROGRAM = """
from pyspark.sql import functions as F
from tidegraph import Step, VertexProgram

class Constant(VertexProgram):
    def __init__(self, value):
        self.value = float(value)

    def compute(self, ctx):
        return Step(value=F.lit(self.value), halt=True)
"""


def test_all_programs_from_the_command_line(spark, tmp_path, monkeypatch):
    put(tmp_path / "g_1", "2\n2\n0 1\n2 3\n")
    put(tmp_path / "g_2", "2\n1\n1 0\n")
    put(tmp_path / "mine.py", PROGRAM)
    monkeypatch.syspath_prepend(str(tmp_path))
    wanted = {
        ("bfs", "--source", "0"): ["0: 0.000000", "1: 1.000000", "2: Infinity", "3: Infinity"],
        ("components",): ["0: 0", "1: 0", "2: 2", "3: 2"],
        ("max",): ["0: 1", "1: 1", "2: 2", "3: 3"],
        ("labels", "--rounds", "1"): ["0: 1", "1: 0", "2: 2", "3: 2"],
        ("in-degree",): ["0: 1.000000", "1: 1.000000", "2: 0.000000", "3: 1.000000"],
        ("run", "mine:Constant", "--args", "2.5"): [f"{k}: 2.500000" for k in range(4)],
    }
    for k, (command, lines) in enumerate(wanted.items()):
        assert main([*command, "--input", f"file://{tmp_path}/g_[0-9]*", "--output", f"{tmp_path}/out{k}", "--parts", "2", "--prefix"]) == 0
        assert sorted(r["value"] for r in spark.read.text(parts_of(f"{tmp_path}/out{k}")).collect()) == lines
    assert main(["partition", "--input", f"{tmp_path}/g_1", f"{tmp_path}/g_2", "--output", f"file://{tmp_path}/p", "--parts", "3", "--prefix"]) == 0
    assert pairs(load_edge_list(spark, parts_of(f"file://{tmp_path}/p"))) == [(0, 1, 0.0), (1, 0, 0.0), (2, 3, 0.0)]
    with pytest.raises(FileExistsError):
        main(["partition", "--input", f"{tmp_path}/g_1", f"{tmp_path}/g_2", "--output", f"file://{tmp_path}/p", "--parts", "3", "--prefix"])


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=context))


def test_the_rest_imports_without_the_llm_folders(tmp_path):
    root = Path(__file__).resolve().parent.parent
    for name in ("tidegraph", "tests"):
        shutil.copytree(root / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e, tidegraph; q = e.queries(); assert len(q) > 40 and q.keys() == e.oracle_sql().keys() and not any(k.startswith('op') for k in q) and tidegraph.__file__.startswith(%r)" % str(tmp_path)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
