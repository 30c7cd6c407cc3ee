"""The registered queries of the graph engine, each beside SQL that gives the same rows.

Graphs are read from the star-schema tables (sources/tables.py). Sums of doubles are rounded to six decimals on both sides, as the
order of messages is open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.aggregators import FoldAggregator, avg, count, maximum, minimum, total
from .functions.shared import settle
from .operators.pagerank import PageRank, pagerank
from .operators.traversal import bfs, in_degrees, label_propagation, propagate_most, shortest_paths, weak_components
from .plans.graph import Graph, dense_vertices
from .plans.program import Context, PandasVertexProgram, Step, VertexProgram
from .plans.superstep import Result, run
from .sources.edge_list import load_edge_list, read_headers
from .sources.sinks import part_of, partition_headers, write_partitioned, write_result
from .sources.tables import part_edges, part_graph, size_of, supply_edges, supply_graph, tree_graph, user_graph, weighted_part_edges

PARTS = 4
#: Rounds that SQL unrolls for programs that run until nothing changes; any number beyond the last change gives the same rows.
ROUNDS, UPDATES = 12, 24
INFINITE = float("inf")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

EDGES = "e AS MATERIALIZED (SELECT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL)"
VERTICES = "v AS MATERIALIZED (SELECT CAST(p_partkey AS BIGINT) AS id FROM part)"
DEGREES = "d AS MATERIALIZED (SELECT src AS id, count(*) AS n FROM e GROUP BY src)"
PART = f"WITH {EDGES}, {VERTICES}, {DEGREES}"
SUPPLY = f"""WITH n AS (SELECT count(*) AS n FROM supplier),
e AS MATERIALIZED (SELECT DISTINCT l_suppkey AS src, l_partkey + n AS dst FROM lineitem, n),
v AS MATERIALIZED (SELECT CAST(s_suppkey AS BIGINT) AS id FROM supplier UNION ALL SELECT CAST(p_partkey + n AS BIGINT) FROM part, n), {DEGREES}"""
USERS = f"""WITH e AS MATERIALIZED (SELECT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id, user_id) AS dst FROM events) WHERE dst IS NOT NULL),
v AS MATERIALIZED (SELECT CAST(range AS BIGINT) AS id FROM range((SELECT max(user_id) + 1 FROM events))), {DEGREES}"""


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def ranks(steps: int) -> str:
    """CTEs pr0..prN: PageRank after so many updates."""
    out = ["pr0 AS MATERIALIZED (SELECT id, CAST(1.0 AS DOUBLE) AS val FROM v)"]
    for k in range(1, steps + 1):
        out.append(f"s{k} AS (SELECT e.dst, sum(p.val / d.n) AS x FROM pr{k - 1} p JOIN d ON d.id = p.id JOIN e ON e.src = p.id GROUP BY e.dst)")
        out.append(f"pr{k} AS MATERIALIZED (SELECT v.id, 0.15::DOUBLE + 0.85::DOUBLE * coalesce(s.x, 0) AS val FROM v LEFT JOIN s{k} s ON s.dst = v.id)")
    return ", ".join(out)


def levels(steps: int, weight: str = "1.0", edges: str = "e") -> str:
    """CTEs l0..lN: least distances from vertex 0 over so many edges."""
    out = ["l0 AS MATERIALIZED (SELECT id, CASE WHEN id = 0 THEN 0.0::DOUBLE ELSE 'inf'::DOUBLE END AS val FROM v)"]
    for k in range(1, steps + 1):
        out.append(f"l{k} AS MATERIALIZED (SELECT p.id, least(p.val, coalesce(m.x, 'inf'::DOUBLE)) AS val FROM l{k - 1} p LEFT JOIN (SELECT w.dst, min(q.val + {weight}) AS x FROM l{k - 1} q JOIN {edges} w ON w.src = q.id GROUP BY w.dst) m ON m.dst = p.id)")
    return ", ".join(out)


def rounded(result: Result) -> DataFrame:
    return result.vertices.select("id", F.round("value", 6).alias("value"))


def one_row(spark: SparkSession, row: tuple, schema: str) -> DataFrame:
    return spark.createDataFrame([row], schema)


class Ask(VertexProgram):
    """Superstep 0 sends, superstep 1 keeps what combine makes of it: the relational reading of one exchange of messages."""

    def __init__(self, made, message=None, targets=None, send=True, skip=None):
        self.combine, self.ordered = {"x": made}, skip is not None
        self._message, self._targets, self._send, self._skip = message, targets, send, skip

    def compute(self, ctx: Context) -> Step:
        if ctx.superstep == 0:
            return Step(halt=True, message=self._message, targets=self._targets, send=self._send, skip=self._skip)
        return Step(value=ctx.inbox("x"), halt=True)


# Sources and layout


@query(f"{PART} SELECT src, dst, count(*) AS n FROM e GROUP BY src, dst")
def load_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_edges(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"{SUPPLY} SELECT v.id, true AS active, coalesce(d.n, 0) AS out_degree, CASE WHEN d.n > 0 THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END AS value FROM v LEFT JOIN d USING (id)")
def dense_vertices_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = size_of(spark, sf_dir, "supplier")
    return dense_vertices(supply_edges(spark, sf_dir, suppliers), suppliers + size_of(spark, sf_dir, "part"), init=1.5)


@query(f"{USERS}, t AS (SELECT count(*) AS n FROM v) SELECT CAST(p AS BIGINT) AS part, CAST(t.n // 4 + CASE WHEN p <= t.n % 4 THEN 1 ELSE 0 END AS BIGINT) AS vertices, (SELECT count(*) FROM e WHERE src % 4 + 1 = p) AS edges FROM range(1, 5) r(p), t")
def edge_header_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the users' graph as edge lists and reads their headers."""
    path = text_graph(spark, user_graph(spark, sf_dir))
    return read_headers(spark, f"{path}/part=*").select(F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part"), "vertices", "edges")


def text_graph(spark: SparkSession, graph: Graph, parts: int = PARTS) -> str:
    _, path = settle(spark.range(1), "text")
    write_partitioned(graph, f"{path}/graph", parts)
    return f"{path}/graph"


@query(f"{USERS} SELECT src, dst, count(*) AS n FROM e GROUP BY src, dst")
def edge_list_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges through text files, headers checked."""
    path = text_graph(spark, user_graph(spark, sf_dir))
    return load_edge_list(spark, f"{path}/part=*").edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"{SUPPLY} SELECT id, 0.0::DOUBLE AS value FROM v WHERE id NOT IN (SELECT src FROM e)")
def isolated_default_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What no edge starts from is there through the vertex count, with the zero value."""
    graph = supply_graph(spark, sf_dir)
    return dense_vertices(graph.edges, graph.vertices.count(), init=1.5).where("out_degree = 0").select("id", "value")


@query(f"{PART} SELECT id, n AS out_degree FROM d")
def out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_graph(spark, sf_dir).out_degrees()


@query(f"{SUPPLY} SELECT id FROM v WHERE id NOT IN (SELECT src FROM e)")
def sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = supply_graph(spark, sf_dir)
    return graph.vertices.join(graph.out_degrees(), "id", "left_anti").select("id")


@query(f"{PART} SELECT src % 4 + 1 AS part, count(*) AS edges FROM e GROUP BY 1")
def hash_partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_edges(spark, sf_dir).groupBy(part_of(F.col("src"), PARTS).alias("part")).agg(F.count("*").alias("edges"))


@query(f"{PART}, t AS (SELECT count(*) AS n FROM v) SELECT CAST(p AS BIGINT) AS part, CAST(t.n // 4 + CASE WHEN p <= t.n % 4 THEN 1 ELSE 0 END AS BIGINT) AS vertices FROM range(1, 5) r(p), t")
def hash_partition_vertex_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition_headers(part_graph(spark, sf_dir), PARTS).select("part", "vertices")


WEIGHTED = "w AS MATERIALIZED (SELECT src, dst, CAST(count(*) AS DOUBLE) AS value FROM e GROUP BY src, dst)"


@query(f"{PART}, {WEIGHTED} SELECT id, dst, value FROM v JOIN w ON src = id")
def edge_iterate_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vertex sends each edge's value along it; what arrives are the edges."""
    graph = Graph.dense(weighted_part_edges(spark, sf_dir), size_of(spark, sf_dir, "part"))
    return arrived(graph, lambda v, e: e.value).select(F.col("src").alias("id"), "dst", F.col("m").alias("value"))


def arrived(graph: Graph, message, skip: int | None = None) -> DataFrame:
    """src, dst, m of every message of one superstep along the edges."""
    graph = Graph(graph.vertices.select("id", F.lit(None).cast("array<struct<src:bigint,m:double>>").alias("value")), graph.edges)
    done = run(graph, Ask(lambda src, m: F.collect_list(F.struct(src.alias("src"), m.alias("m"))), message=message, skip=skip))
    return done.vertices.select(F.col("id").alias("dst"), F.inline("value"))


@query(f"{PART} SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM e) WHERE k > 2")
def edge_skip_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages along all out-edges but the first two."""
    return arrived(part_graph(spark, sf_dir), lambda v, e: F.lit(1.0), skip=2).select("src", "dst")


# Messages


@query(f"{PART} SELECT v.id, round(s.x, 6) AS value FROM v LEFT JOIN (SELECT dst, CAST(sum(src) AS DOUBLE) AS x FROM e GROUP BY dst) s ON s.dst = v.id")
def deliver_inbox_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = part_graph(spark, sf_dir)
    graph = Graph(graph.vertices.withColumn("value", F.lit(None).cast("double")), graph.edges)
    return rounded(run(graph, Ask(lambda src, m: F.sum(m), message=lambda v, e: v.id.cast("double"))))


@query(f"{PART} SELECT v.id, CAST(coalesce(s.x, 0) AS DOUBLE) AS value FROM v LEFT JOIN (SELECT dst, count(*) AS x FROM e GROUP BY dst) s ON s.dst = v.id")
def send_all_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(in_degrees(part_graph(spark, sf_dir)))


@query(f"{PART} SELECT v.id, CAST(coalesce(s.x, 0) AS BIGINT) AS value FROM v LEFT JOIN (SELECT dst, count(*) AS x FROM e GROUP BY dst) s ON s.dst = v.id")
def deliver_inbox_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = part_graph(spark, sf_dir)
    graph = Graph(graph.vertices.select("id", F.lit(0).cast("long").alias("value")), graph.edges)
    return run(graph, Ask(lambda src, m: F.count(m), message=lambda v, e: F.lit(1.0))).vertices.select("id", F.coalesce("value", F.lit(0).cast("long")).alias("value"))


@query(f"{PART} SELECT dst AS id, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS sources FROM e GROUP BY dst")
def deliver_src_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message is seen by itself, with its source."""
    graph = part_graph(spark, sf_dir)
    graph = Graph(graph.vertices.select("id", F.lit(None).cast("array<bigint>").alias("value")), graph.edges)
    done = run(graph, Ask(lambda src, m: F.array_sort(F.collect_list(src)), message=lambda v, e: F.lit(0.0)))
    return done.vertices.where("value IS NOT NULL").select("id", F.array_join("value", ",").alias("sources"))


@query(f"{PART}, m AS (SELECT (id * 7 + 3) % (SELECT count(*) FROM v) AS dst, id AS src FROM v) SELECT v.id, CAST(sum(m.src) AS DOUBLE) AS value FROM v LEFT JOIN m ON m.dst = v.id GROUP BY v.id")
def send_to_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages to vertices that are no neighbours."""
    graph, n = part_graph(spark, sf_dir), size_of(spark, sf_dir, "part")
    graph = Graph(graph.vertices.withColumn("value", F.lit(None).cast("double")), graph.edges)
    target = F.array(F.struct(((F.col("id") * 7 + 3) % n).alias("dst"), F.col("id").cast("double").alias("value")))
    return rounded(run(graph, Ask(lambda src, m: F.sum(m), targets=target)))


@query(f"{PART}, t AS (SELECT count(*) AS n FROM v), m AS (SELECT id AS dst, id AS src FROM v UNION ALL SELECT (id + 1) % n, id FROM v, t) SELECT dst AS id, CAST(sum(src) AS DOUBLE) AS value FROM m GROUP BY dst")
def send_to_self_and_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, n = part_graph(spark, sf_dir), size_of(spark, sf_dir, "part")
    value = F.col("id").cast("double").alias("value")
    target = F.array(F.struct(F.col("id").alias("dst"), value), F.struct(((F.col("id") + 1) % n).alias("dst"), value))
    return rounded(run(graph, Ask(lambda src, m: F.sum(m), targets=target)))


class Wake(VertexProgram):
    """All halt at once; those that a message wakes note the superstep."""

    def compute(self, ctx: Context) -> Step:
        if ctx.superstep == 0:
            return Step(value=F.lit(0.0), halt=True, send=ctx.id % 10 == 0, message=lambda v, e: F.lit(1.0))
        return Step(value=F.lit(float(ctx.superstep)), halt=True)


@query(f"{PART} SELECT id, CASE WHEN id IN (SELECT dst FROM e WHERE src % 10 = 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM v")
def wake_on_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(run(part_graph(spark, sf_dir), Wake()))


class HaltThirds(VertexProgram):
    def compute(self, ctx: Context) -> Step:
        return Step(halt=ctx.id % 3 == 0)


@query("SELECT CAST(p_partkey AS BIGINT) AS id, p_partkey % 3 <> 0 AS active FROM part")
def active_after_halt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(part_graph(spark, sf_dir), HaltThirds(), max_supersteps=1).vertices.select("id", "active")


class Unread(VertexProgram):
    """Messages of superstep 0 aren't read in superstep 1 and are gone in superstep 2."""

    def compute(self, ctx: Context) -> Step:
        if ctx.superstep == 0:
            return Step(message=lambda v, e: F.lit(1.0))
        return Step(value=ctx.received.cast("double"), halt=True) if ctx.superstep == 2 else Step()


@query("SELECT CAST(p_partkey AS BIGINT) AS id, 0.0::DOUBLE AS value FROM part")
def inbox_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(run(part_graph(spark, sf_dir), Unread()))


# Counters, aggregators, control


def report_of(spark: SparkSession, result: Result) -> DataFrame:
    rows = [(r["superstep"], r["computed"], r["active"], r["sent"]) for r in result.report]
    return spark.createDataFrame(rows, "superstep int, computed long, active long, sent long")


@query(f"{PART} SELECT CAST(s AS INTEGER) AS superstep, (SELECT count(*) FROM v) AS computed, (SELECT count(*) FROM v) AS active, (SELECT count(*) FROM e) AS sent FROM range(4) r(s)")
def superstep_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_of(spark, pagerank(part_graph(spark, sf_dir), max_supersteps=4))


def _frontiers(steps: int) -> str:
    rows = ["SELECT 0 AS superstep, (SELECT count(*) FROM v) AS computed, 0::BIGINT AS active, (SELECT n FROM d WHERE id = 0) AS sent"]
    for k in range(1, steps):
        rows.append(
            f"SELECT {k}, (SELECT count(DISTINCT e.dst) FROM e JOIN l{k - 1} q ON q.id = e.src WHERE q.val = {k - 1}), 0::BIGINT, (SELECT CAST(coalesce(sum(d.n), 0) AS BIGINT) FROM l{k} q JOIN d USING (id) WHERE q.val = {k})"
        )
    return f"{PART}, {levels(steps)} SELECT * FROM ({' UNION ALL '.join(rows)})"


@query(_frontiers(4))
def search_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only vertices with messages run after superstep 0."""
    return report_of(spark, bfs(part_graph(spark, sf_dir), 0, max_supersteps=4))


class Contribute(VertexProgram):
    aggregators = {"sum": total(0.0), "least": minimum(), "most": maximum(), "count": count(), "mean": avg(), "silent": total(-1.0)}

    def compute(self, ctx: Context) -> Step:
        if ctx.superstep == 0:
            degree = ctx.out_degree.cast("double")
            return Step(contribute={n: degree for n in ("sum", "least", "most", "count", "mean")})
        return Step(halt=True, contribute={"sum": F.when(ctx.id % 2 == 0, F.lit(1.0))})


def contributed(spark: SparkSession, sf_dir: str, steps: int) -> dict:
    return run(part_graph(spark, sf_dir), Contribute(), max_supersteps=steps).globals


@query(f"{PART} SELECT CAST(sum(n) AS DOUBLE) AS total FROM d")
def aggr_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_row(spark, (contributed(spark, sf_dir, 1)["sum"],), "total double")


@query(f"{PART} SELECT CAST(min(coalesce(d.n, 0)) AS DOUBLE) AS least, CAST(max(d.n) AS DOUBLE) AS most FROM v LEFT JOIN d USING (id)")
def aggr_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contributed(spark, sf_dir, 1)
    return one_row(spark, (found["least"], found["most"]), "least double, most double")


@query("SELECT count(*) AS n FROM part")
def aggr_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_row(spark, (contributed(spark, sf_dir, 1)["count"],), "n long")


@query(f"{PART} SELECT CAST(sum(coalesce(d.n, 0)) AS DOUBLE) AS total, count(*) AS n, round(avg(coalesce(d.n, 0)), 6) AS mean, -1.0::DOUBLE AS silent FROM v LEFT JOIN d USING (id)")
def aggr_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contributed(spark, sf_dir, 1)
    return one_row(spark, (found["sum"], found["count"], round(found["mean"], 6), found["silent"]), "total double, n long, mean double, silent double")


@query("SELECT CAST(count(*) AS DOUBLE) AS total, 0::BIGINT AS n FROM part WHERE p_partkey % 2 = 0")
def aggr_non_sticky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second superstep starts from the initial values."""
    found = contributed(spark, sf_dir, 2)
    return one_row(spark, (found["sum"], found["count"]), "total double, n long")


class Spread(VertexProgram):
    aggregators = {"range": FoldAggregator((INFINITE, -INFINITE), lambda a, x: (min(a[0], x), max(a[1], x)), lambda a, b: (min(a[0], b[0]), max(a[1], b[1])))}

    def compute(self, ctx: Context) -> Step:
        return Step(halt=True, contribute={"range": ctx.out_degree.cast("double")})


@query(f"{PART} SELECT CAST(max(coalesce(d.n, 0)) - min(coalesce(d.n, 0)) AS DOUBLE) AS spread FROM v LEFT JOIN d USING (id)")
def aggr_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = run(part_graph(spark, sf_dir), Spread()).globals["range"]
    return one_row(spark, (high - low,), "spread double")


@query(f"{PART}, {ranks(3)} SELECT id, round(val, 6) AS value FROM pr3")
def master_stop_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The master ends the job after superstep 3; messages in flight are lost."""
    return rounded(run(part_graph(spark, sf_dir), PageRank(), master=lambda step, known: step == 3))


class ReadGlobal(VertexProgram):
    aggregators = {"g": total(0.0)}

    def compute(self, ctx: Context) -> Step:
        return Step(value=F.lit(float(ctx.aggregate("g"))), halt=ctx.superstep == 1 or False, contribute={"g": F.lit(1.0)})


@query("SELECT CAST(p_partkey AS BIGINT) AS id, CAST((SELECT count(*) FROM part) + 42 AS DOUBLE) AS value FROM part")
def master_rewrite_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    def master(step: int, known: dict) -> bool:
        known["g"] += 42
        return False

    return rounded(run(part_graph(spark, sf_dir), ReadGlobal(), master=master))


@query(f"{PART}, {levels(ROUNDS)} SELECT CAST(max(val) + 2 AS BIGINT) AS supersteps FROM l{ROUNDS} WHERE val < 'inf'::DOUBLE")
def quiescence_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search ends once no message is in flight: one superstep after the last level was reached."""
    return one_row(spark, (bfs(part_graph(spark, sf_dir), 0).supersteps,), "supersteps long")


# PageRank


@query("SELECT CAST(p_partkey AS BIGINT) AS id, 1.0::DOUBLE AS value FROM part")
def pagerank_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pagerank(part_graph(spark, sf_dir), max_supersteps=1))


@query(f"{PART}, {ranks(1)} SELECT id, round(val, 6) AS value FROM pr1")
def pagerank_1step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pagerank(part_graph(spark, sf_dir), max_supersteps=2))


@query(f"{PART}, {ranks(10)} SELECT id, round(val, 6) AS value FROM pr10")
def pagerank_k10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pagerank(part_graph(spark, sf_dir), max_supersteps=11))


@query(f"{SUPPLY}, {ranks(3)} SELECT id, round(val, 6) AS value FROM pr3")
def pagerank_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sinks send nothing, and their rank is lost."""
    return rounded(pagerank(supply_graph(spark, sf_dir)))


def _converged() -> str:
    """The ranks after the first update that changes them by less than 1e-6 in all."""
    numbers = range(1, UPDATES + 1)
    changes = " UNION ALL ".join(f"SELECT {k} AS k, sum(abs(a.val - b.val)) AS x FROM pr{k} a JOIN pr{k - 1} b USING (id)" for k in numbers)
    rows = " UNION ALL ".join(f"SELECT id, round(val, 6) AS value FROM pr{k} WHERE (SELECT k FROM stop) = {k}" for k in numbers)
    return f"{PART}, {ranks(UPDATES)}, changes AS MATERIALIZED ({changes}), stop AS MATERIALIZED (SELECT min(k) AS k FROM changes WHERE x < 1e-6) SELECT * FROM ({rows})"


@query(_converged())
def pagerank_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pagerank(part_graph(spark, sf_dir)))


@query(f"{USERS}, {ranks(5)} SELECT id, round(val, 6) AS value FROM pr5")
def pagerank_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pagerank(user_graph(spark, sf_dir), max_supersteps=6))


@query(f"{PART}, {ranks(5)} SELECT id || ': ' || printf('%.6f', val) AS line FROM pr5")
def pagerank_output_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks through the text sink."""
    done = pagerank(part_graph(spark, sf_dir), max_supersteps=6)
    _, path = settle(spark.range(1), "ranks")
    write_result(done.vertices, f"{path}/out", parts=PARTS)
    return spark.read.text(f"{path}/out/part=*").select(F.col("value").alias("line"))


class PythonPageRank(PandasVertexProgram):
    """PageRank vertex by vertex, with single messages."""

    aggregators = {"change": FoldAggregator(0.0, lambda a, x: a + x, lambda a, b: a + b)}

    def compute(self, vertex) -> None:
        if vertex.superstep >= 2 and vertex.aggregate("change") < 1e-6:
            vertex.vote_to_halt()
            return
        if vertex.superstep == 0:
            value = 1.0
        else:
            value = 0.15 + 0.85 * sum(m for _, m in vertex.messages)
            vertex.contribute("change", abs(vertex.value - value))
        vertex.value = value
        if vertex.out_edges:
            vertex.send_to_all_neighbors(value / len(vertex.out_edges))


@query(f"{USERS}, {ranks(3)} SELECT id, round(val, 6) AS value FROM pr3")
def pagerank_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(run(user_graph(spark, sf_dir), PythonPageRank(), max_supersteps=4))


# Further programs


@query(f"{PART}, {levels(ROUNDS)} SELECT id, CASE WHEN val < 'inf'::DOUBLE THEN val END AS level FROM l{ROUNDS}")
def breadth_first_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bfs(part_graph(spark, sf_dir), 0).vertices.select("id", F.when(F.col("value") < INFINITE, F.col("value")).alias("level"))


@query(f"{PART}, {WEIGHTED}, {levels(ROUNDS, 'w.value', 'w')} SELECT id, CASE WHEN val < 'inf'::DOUBLE THEN val END AS distance FROM l{ROUNDS}")
def sssp_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = Graph.dense(weighted_part_edges(spark, sf_dir), size_of(spark, sf_dir, "part"))
    return shortest_paths(graph, 0).vertices.select("id", F.when(F.col("value") < INFINITE, F.col("value")).alias("distance"))


@query(
    """WITH o AS (SELECT (SELECT count(*) FROM region) AS r, (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM customer) AS c)
SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(r_regionkey AS BIGINT) AS value FROM region
UNION ALL SELECT r + n_nationkey, CAST(n_regionkey AS BIGINT) FROM nation, o
UNION ALL SELECT r + n + c_custkey, CAST(n_regionkey AS BIGINT) FROM customer JOIN nation ON c_nationkey = n_nationkey, o
UNION ALL SELECT r + n + c + s_suppkey, CAST(n_regionkey AS BIGINT) FROM supplier JOIN nation ON s_nationkey = n_nationkey, o"""
)
def weakly_connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_components(tree_graph(spark, sf_dir)).vertices.select("id", "value")


def _most(steps: int) -> str:
    out = ["m0 AS MATERIALIZED (SELECT id, id AS val FROM v)"]
    for k in range(1, steps + 1):
        out.append(f"m{k} AS MATERIALIZED (SELECT p.id, greatest(p.val, coalesce(x.x, p.val)) AS val FROM m{k - 1} p LEFT JOIN (SELECT e.dst, max(q.val) AS x FROM m{k - 1} q JOIN e ON e.src = q.id GROUP BY e.dst) x ON x.dst = p.id)")
    return ", ".join(out)


@query(f"{PART}, {_most(ROUNDS)} SELECT id, val AS value FROM m{ROUNDS}")
def max_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = part_graph(spark, sf_dir)
    numbered = Graph(graph.vertices.select("id", F.col("id").alias("value")), graph.edges)
    return propagate_most(numbered).vertices.select("id", "value")


def _labels(rounds: int) -> str:
    out = ["l0 AS MATERIALIZED (SELECT id, id AS val FROM v)"]
    for k in range(1, rounds + 1):
        most = f"SELECT dst, val FROM (SELECT e.dst, q.val, row_number() OVER (PARTITION BY e.dst ORDER BY count(*) DESC, q.val) AS k FROM l{k - 1} q JOIN e ON e.src = q.id GROUP BY e.dst, q.val) WHERE k = 1"
        out.append(f"l{k} AS MATERIALIZED (SELECT p.id, coalesce(m.val, p.val) AS val FROM l{k - 1} p LEFT JOIN ({most}) m ON m.dst = p.id)")
    return ", ".join(out)


@query(f"{PART}, {_labels(3)} SELECT id, val AS value FROM l3")
def label_prop_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = part_graph(spark, sf_dir)
    numbered = Graph(graph.vertices.select("id", F.col("id").alias("value")), graph.edges)
    return label_propagation(numbered, 3).vertices.select("id", "value")


@query(f"{PART} SELECT v.id, CAST(count(e.dst) AS DOUBLE) AS value FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id")
def in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(in_degrees(part_graph(spark, sf_dir)))


@query(f"{PART}, {levels(2)} SELECT id FROM l2 WHERE val <= 2")
def reach_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is at most two edges away from vertex 0."""
    return bfs(part_graph(spark, sf_dir), 0, max_supersteps=3).vertices.where(F.col("value") <= 2).select("id")
