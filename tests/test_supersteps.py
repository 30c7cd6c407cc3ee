"""Semantics of supersteps on small graphs."""

import random

import pytest
from pyspark.sql import functions as F

from tidegraph import FoldAggregator, Graph, PandasVertexProgram, Step, VertexProgram, run, total
from tidegraph.operators.pagerank import pagerank
from tidegraph.operators.traversal import bfs, in_degrees, propagate_most, shortest_paths, weak_components
from tidegraph.plans.superstep import UndeliverableMessage

TINY = [(0, 1), (0, 3), (1, 0), (1, 2), (1, 3), (2, 1), (2, 4), (3, 0), (3, 1), (3, 4), (4, 3), (4, 2)]


def graph(spark, edges, n, **values):
    kind = "src long, dst long" if not edges or len(edges[0]) == 2 else "src long, dst long, value double"
    return Graph.dense(spark.createDataFrame(edges, kind), n, **values)


def values(result):
    return {r["id"]: r["value"] for r in result.vertices.collect()}


def test_pagerank_converges_to_known_values(spark):
    done = pagerank(graph(spark, TINY, 5))
    assert done.supersteps == 20 and done.stopped_by == "quiescence"
    assert sum(r["sent"] for r in done.report) == 228
    assert {k: round(v, 6) for k, v in values(done).items()} == {0: 0.840473, 1: 1.218482, 2: 0.861281, 3: 1.218482, 4: 0.861281}


def test_sinks_leak_rank_and_never_divide(spark):
    done = pagerank(graph(spark, [(0, 1)], 2))
    assert {k: round(v, 6) for k, v in values(done).items()} == {0: 0.15, 1: round(0.15 + 0.85 * 0.15, 6)}


def test_isolated_vertex_exists_and_runs_once(spark):
    done = run(graph(spark, [], 1), Halt())
    assert values(done) == {0: 0.0} and done.report == [{"superstep": 0, "active": 0, "computed": 1, "received": 0, "sent": 0, "dropped": 0}]


def test_loader_values_only_reach_vertices_with_out_edges(spark):
    assert {r["id"]: r["value"] for r in graph(spark, [(0, 1)], 3, init=7.0).vertices.collect()} == {0: 7.0, 1: 0.0, 2: 0.0}


class Halt(VertexProgram):
    def compute(self, ctx):
        return Step(halt=True)


def test_messages_wake_halted_vertices_one_superstep_later(spark):
    done = propagate_most(Graph(spark.createDataFrame([(k, float(k)) for k in range(5)], "id long, value double"), spark.createDataFrame([(3, 2), (2, 1), (1, 0)], "src long, dst long")))
    assert [r["computed"] for r in done.report] == [5, 3, 2, 1]
    assert [r["sent"] for r in done.report] == [3, 2, 1, 0]
    assert values(done) == {0: 3.0, 1: 3.0, 2: 3.0, 3: 3.0, 4: 4.0}


def test_parallel_edges_each_carry_a_message(spark):
    done = in_degrees(graph(spark, [(0, 1), (0, 1)], 2))
    assert values(done)[1] == 2.0 and done.report[0]["sent"] == 2


def test_self_loop_arrives_in_the_next_superstep(spark):
    done = in_degrees(graph(spark, [(0, 0)], 1))
    assert [r["received"] for r in done.report] == [0, 1]


def test_weighted_star(spark):
    edges = [(0, k, float(k)) for k in range(1, 6)]
    assert values(shortest_paths(graph(spark, edges, 6), 0)) == {k: float(k) for k in range(6)}


class Direct(VertexProgram):
    combine = {"sum": lambda src, m: F.sum(m)}

    def __init__(self, dst):
        self.dst = dst

    def compute(self, ctx):
        if ctx.superstep:
            return Step(value=ctx.inbox("sum"), halt=True)
        return Step(halt=True, targets=F.when(ctx.id == 0, F.array(F.struct(F.lit(self.dst).cast("long").alias("dst"), F.lit(2.5).alias("value")))))


def test_message_to_a_vertex_that_is_no_neighbour(spark):
    assert values(run(graph(spark, [(0, 1)], 3), Direct(2)))[2] == 2.5


def test_messages_to_missing_vertices_are_dropped_and_counted(spark):
    done = run(graph(spark, [(0, 1)], 3), Direct(99))
    assert [r["dropped"] for r in done.report] == [0, 1]
    with pytest.raises(UndeliverableMessage):
        run(graph(spark, [(0, 1)], 3), Direct(99), strict=True)


class Stay(VertexProgram):
    aggregators = {"n": total(0.0), "silent": total(-3.0)}

    def compute(self, ctx):
        return Step(value=F.lit(float(ctx.aggregate("n"))), contribute={"n": F.lit(1.0)} if ctx.superstep != 1 else {})


def test_vertices_that_never_vote_run_until_a_limit(spark):
    done = run(graph(spark, [], 3), Stay(), max_supersteps=3)
    assert done.stopped_by == "max_supersteps" and [r["active"] for r in done.report] == [3, 3, 3]


def test_aggregates_start_anew_each_superstep(spark):
    seen = []

    def master(step, known):
        seen.append(dict(known))
        return step == 2

    done = run(graph(spark, [], 3), Stay(), master=master)
    assert [x["n"] for x in seen] == [3.0, 0.0, 3.0] and seen[0]["silent"] == -3.0
    assert values(done)[0] == 0.0 and done.stopped_by == "master"


def test_master_rewrites_what_vertices_read_next(spark):
    def master(step, known):
        known["n"] = 42.0
        return step == 1

    assert set(values(run(graph(spark, [], 2), Stay(), master=master)).values()) == {42.0}


def test_master_runs_in_the_last_superstep_too(spark):
    steps = []
    run(graph(spark, [], 1), Halt(), master=lambda step, known: steps.append(step) or False)
    assert steps == [0]


def test_stopping_drops_messages_in_flight(spark):
    done = run(graph(spark, [(0, 1)], 2), Direct(1), master=lambda step, known: True)
    assert done.report[0]["sent"] == 1 and values(done) == {0: 0.0, 1: 0.0}


class Ignore(VertexProgram):
    def compute(self, ctx):
        if ctx.superstep == 0:
            return Step(message=lambda v, e: F.lit(1.0))
        return Step(value=ctx.received.cast("double"), halt=ctx.superstep == 2)


def test_unread_messages_are_gone(spark):
    assert values(run(graph(spark, [(0, 1)], 2), Ignore()))[1] == 0.0


class Structs(VertexProgram):
    """Values may be structs."""

    combine = {"most": lambda src, m: F.max(m)}
    message_type = "struct<a:bigint,b:double>"

    def compute(self, ctx):
        if ctx.superstep == 0:
            return Step(halt=True, message=lambda v, e: F.struct(v.id.alias("a"), F.lit(0.5).alias("b")))
        return Step(value=ctx.inbox("most"), halt=True)


def test_struct_values(spark):
    vertices = spark.range(2).select("id", F.lit(None).cast("struct<a:bigint,b:double>").alias("value"))
    done = run(Graph(vertices, spark.createDataFrame([(0, 1)], "src long, dst long")), Structs())
    assert values(done)[1] == (0, 0.5)


def test_schemas_are_checked(spark):
    with pytest.raises(TypeError):
        Graph(spark.createDataFrame([(1, 0.0)], "id int, value double"), spark.createDataFrame([(1, 1)], "src long, dst long"))
    with pytest.raises(KeyError):
        run(graph(spark, [], 1), Unknown())


class Unknown(VertexProgram):
    def compute(self, ctx):
        return Step(halt=True, contribute={"no": F.lit(1)})


class PythonLeast(PandasVertexProgram):
    """Least id that reaches a vertex, and how many vertices changed."""

    aggregators = {"changed": FoldAggregator(0, lambda a, x: a + x, lambda a, b: a + b)}
    contribution_type = "bigint"

    def compute(self, vertex):
        least = min([vertex.value, *(m for _, m in vertex.messages)])
        if vertex.superstep == 0 or least < vertex.value:
            vertex.send_to_all_neighbors(least)
            vertex.contribute("changed", 1)
        vertex.value = least
        vertex.vote_to_halt()


def test_python_and_column_programs_agree_on_random_graphs(spark):
    rng = random.Random(7)
    for n, m, partitions in ((9, 14, 2), (12, 30, 5)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        both = edges + [(b, a) for a, b in edges]
        numbered = spark.range(n).select("id", F.col("id").cast("double").alias("value"))
        frame = spark.createDataFrame(both, "src long, dst long")
        ours = run(Graph(numbered, frame), PythonLeast(), partitions=partitions)
        assert values(ours) == values(weak_components(Graph(numbered, spark.createDataFrame(edges, "src long, dst long")), partitions=3))
        assert ours.globals["changed"] == 0


class Skip(PandasVertexProgram):
    def compute(self, vertex):
        vertex.value = float(sum(1 for _ in vertex.edges_from(2)))
        vertex.vote_to_halt()


def test_python_programs_skip_edges(spark):
    assert values(run(graph(spark, [(0, k) for k in range(5)], 5), Skip()))[0] == 3.0


def test_results_do_not_depend_on_partitions_or_row_order(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(20), rng.randrange(20)) for _ in range(60)]
    shuffled = edges[:]
    rng.shuffle(shuffled)
    a = values(bfs(graph(spark, edges, 20), 0, partitions=1))
    assert a == values(bfs(graph(spark, shuffled, 20), 0, partitions=7))


def exchanges(plan) -> list[str]:
    """Shuffles of a physical plan, without those of what it reads from memory."""
    found = [plan.nodeName()] if plan.nodeName() == "Exchange" else []
    inner = plan.children()
    if plan.nodeName() == "AdaptiveSparkPlan":
        return exchanges(plan.initialPlan())
    return found + [x for k in range(inner.size()) for x in exchanges(inner.apply(k))]


def test_a_superstep_shuffles_its_messages_only(spark):
    from tidegraph.operators.pagerank import PageRank
    from tidegraph.plans import superstep

    edges = spark.range(2000).select((F.col("id") % 97).alias("src"), (F.col("id") % 89).alias("dst"))
    graph = Graph.dense(edges, 100)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        count = int(spark.conf.get("spark.sql.shuffle.partitions"))
        degrees = graph.out_degrees()
        made = superstep._Columns(graph, PageRank(), graph.edges, degrees, count)
        state = graph.initial_state(degrees).repartition(count, "id").persist()
        first = made.superstep(state, None, 0, {"change": 0.0}).persist()
        first.count()
        second = made.superstep(first, made.messages(first), 1, {"change": 0.0})
        assert exchanges(second._jdf.queryExecution().executedPlan()) == ["Exchange"]
        made.clear()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_out_edges_of_a_hub_are_spread(spark, monkeypatch):
    from tidegraph.operators.traversal import in_degrees
    from tidegraph.plans import superstep

    monkeypatch.setattr(superstep, "PLAIN", 100)
    star = spark.range(1, 20_000).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    graph = Graph.dense(star.union(spark.createDataFrame([(5, 6)], "src long, dst long")), 20_000)
    made = superstep._Columns(graph, superstep.VertexProgram(), graph.edges, graph.out_degrees(), 4)
    sizes = [r["count"] for r in made.heavy.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 6000 and made.light.count() == 1
    made.clear()
    found = {r["id"]: r["value"] for r in in_degrees(graph).vertices.collect()}
    assert found == {k: 0.0 if k == 0 else 2.0 if k == 6 else 1.0 for k in range(20_000)}


def test_ids_beyond_doubles_stay_apart(spark):
    from tidegraph.operators.traversal import label_propagation, propagate_most, weak_components

    big = 2**53
    ids = [big, big + 1, big + 2, big + 3]
    vertices = spark.createDataFrame([(i, i) for i in ids], "id long, value long")
    graph = Graph(vertices, spark.createDataFrame([(big, big + 2), (big + 1, big + 3)], "src long, dst long"))
    values = lambda result: {r["id"]: r["value"] for r in result.vertices.collect()}
    assert values(weak_components(graph)) == {big: big, big + 2: big, big + 1: big + 1, big + 3: big + 1}
    assert values(propagate_most(graph)) == {i: i for i in ids}
    assert values(label_propagation(graph, 1)) == {big: big, big + 2: big, big + 1: big + 1, big + 3: big + 1}


def test_hooks_indexes_and_skips(spark):
    from tidegraph import Step, VertexProgram, run, total

    class Counted(VertexProgram):
        combine = {"n": lambda src, value: F.count(value)}
        aggregators = {"first": total(0.0), "second": total(0.0)}
        ordered = True

        def init(self, graph):
            self.seen = ["init"]

        def term(self, result):
            self.seen.append(result.supersteps)

        def compute(self, ctx):
            if ctx.superstep == 0:
                return Step(contribute={1: F.lit(1.0), "first": F.lit(2.0)}, message=lambda v, e: e.dst.cast("double"), skip=1)
            self.seen.append((ctx.aggregate(0), ctx.aggregate(1), ctx.aggregate("second")))
            return Step(value=F.coalesce(ctx.inbox("n"), F.lit(0)).cast("double"), halt=True)

    edges = spark.createDataFrame([(0, 1), (0, 2), (0, 2), (1, 0)], "src long, dst long")
    program = Counted()
    done = run(Graph.dense(edges, 3), program)
    assert program.seen == ["init", (6.0, 3.0, 3.0), 2] and done.report[0]["sent"] == 2 == done.report[1]["received"]
    assert {r["id"]: r["value"] for r in done.vertices.collect()} == {0: 0.0, 1: 0.0, 2: 2.0}


def test_sums_are_sent_as_a_row_for_each_pair_of_parts(spark):
    from tidegraph.operators.pagerank import PageRank
    from tidegraph.plans import superstep

    edges = spark.range(20_000).select((F.col("id") % 97).alias("src"), (F.col("id") % 89).alias("dst"))
    graph = Graph.dense(edges, 100)
    made = superstep._supersteps(graph, PageRank(), graph.edges, graph.out_degrees(), 4, 3)
    state = graph.initial_state().repartition(made.count, "id").persist()
    made.deal(state)
    first = made.superstep(state, None, 0, {"change": 0.0})
    assert made.messages(first).count() <= 9  # 8633 pairs of vertices have edges
    made.clear()


class SomeSend(VertexProgram):
    """A third of the vertices sends nothing, some send null; others have no out-edges, so that they mustn't divide."""

    combine = {"sum": lambda src, value: F.sum(value)}

    def compute(self, ctx):
        if ctx.superstep == 0:
            return Step(halt=True, send=ctx.id % 3 != 0, message=lambda v, e: F.when(v.id % 5 != 0, (v.id * 60) / v.out_degree))
        return Step(value=F.coalesce(ctx.inbox("sum"), F.lit(-1.0)), halt=True)


class SomeSendArrays(SomeSend):
    summed = "sum"


def test_sums_as_arrays_equal_those_of_messages(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(25), rng.randrange(40)) for _ in range(60)] + [(1, 2), (1, 2), (1, 77), (88, 3), (10, 39), (10, 38)]
    vertices = spark.range(40).where("id <> 7").select("id", F.lit(0.0).alias("value"))
    both = [run(Graph(vertices, spark.createDataFrame(edges, "src long, dst long")), program, partitions=3) for program in (SomeSend(), SomeSendArrays())]
    assert both[0].report == both[1].report and both[0].report[1]["dropped"] > 0
    assert {k: round(v, 9) for k, v in values(both[0]).items()} == {k: round(v, 9) for k, v in values(both[1]).items()}
