"""The superstep loop: each superstep is one DataFrame plan with one shuffle, that of its messages.

The edges are written to the shared folder once and dealt by src, the state by id to the same parts, and both are kept in memory
(lost parts are computed again), so that neither the inbox's join nor that of senders and edges moves them; Spark broadcasts
the senders instead where they are small. Sources with more than a fair part of all edges, which are few by that definition,
are broadcast to their edges, which lie in all parts. Messages are combined before and after their shuffle by destination.
Programs that send one number along all of a vertex's out-edges and read their sum have no row per edge: the edges of two parts are
kept as places in arrays, and a superstep shuffles a row of sums for each pair of parts (_Arrays).
Counters and aggregates of a superstep are one aggregate over its state, which computes it. Every CUT supersteps the state is
written to the shared folder and dealt anew, as plans name their state twice and would double with each superstep; that bounds
the lineage too, and what is written outlives executors.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.aggregators import FoldAggregator
from ..functions.shared import remove, settle
from ..functions.shipping import ship_by_value
from .graph import Graph
from .program import Context, PandasVertexProgram, Row, Step, Vertex, VertexProgram, named


#: Supersteps after which the state is written; edges up to which no source counts as large; vertices and edges of a task that holds arrays.
CUT, PLAIN, ARRAY_ROWS = 2, 100_000, 1_000_000


class UndeliverableMessage(RuntimeError):
    """A message went to a vertex that isn't there."""


@dataclass
class Result:
    """vertices: id, value, active after the last superstep. report: a row of counters per superstep. globals: the aggregates then."""

    vertices: DataFrame
    report: list[dict[str, int]]
    globals: dict[str, Any]
    stopped_by: str
    seconds: float

    @property
    def supersteps(self) -> int:
        return len(self.report)


Master = Callable[[int, dict[str, Any]], bool]


def run(
    graph: Graph,
    program: VertexProgram | PandasVertexProgram,
    max_supersteps: int | None = None,
    master: Master | None = None,
    strict: bool = False,
    partitions: int | None = None,
) -> Result:
    """Runs supersteps until no vertex is active and none has sent a message, until master(superstep, aggregates) is true, or
    until max_supersteps have run.

    master runs after every superstep and may change the aggregates that vertices read in the next. Messages to
    vertices that aren't there are dropped and counted, or with strict raise UndeliverableMessage.
    """
    spark = graph.vertices.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    program.init(graph)
    raw, raw_path = settle(graph.edges, "edges")
    degrees, degrees_path = settle(raw.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree")), "degrees")
    made = _supersteps(graph, program, raw, degrees, count, partitions)
    count = made.count
    state = graph.initial_state(degrees).repartition(count, "id").persist(StorageLevel.MEMORY_AND_DISK)
    made.deal(state)
    paths: list[str] = []
    messages: DataFrame | None = None
    known = {name: a.init for name, a in program.aggregators.items()}
    report: list[dict[str, int]] = []
    sent_before = 0
    began = time.perf_counter()
    while True:
        step = len(report)
        before, state = state, made.superstep(state, messages, step, known).persist(StorageLevel.MEMORY_AND_DISK)
        row = state.agg(*made.measures()).first().asDict()
        before.unpersist()
        counters = {c: int(row.get(c) or 0) for c in ("active", "computed", "received", "sent")}
        known = made.aggregates(row, state)
        counters["dropped"] = sent_before - counters["received"]
        report.append({"superstep": step, **counters})
        if strict and counters["dropped"]:
            raise UndeliverableMessage(f"superstep {step}: {counters['dropped']} messages went to vertices that aren't there")
        sent_before = counters["sent"]
        stop = bool(master and master(step, known))
        if stop or not counters["active"] and not counters["sent"]:
            stopped = "master" if stop else "quiescence"
            break
        if max_supersteps is not None and len(report) >= max_supersteps:
            stopped = "max_supersteps"
            break
        if len(report) % CUT == 0:
            before, (written, path) = state, settle(state, "state")
            state = written.repartition(count, "id").persist(StorageLevel.MEMORY_AND_DISK)
            state.count()
            before.unpersist()
            for old in paths:
                remove(spark, old)
            paths = [path]
        messages = made.messages(state)
    seconds = time.perf_counter() - began
    vertices, _ = settle(state.select("id", "value", "active"), "vertices")
    state.unpersist()
    made.clear()
    for old in (*paths, raw_path, degrees_path):
        remove(spark, old)
    result = Result(vertices, report, known, stopped, seconds)
    program.term(result)
    return result


def _column(x: Column | bool) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _supersteps(graph: Graph, program: VertexProgram | PandasVertexProgram, edges: DataFrame, degrees: DataFrame, count: int, partitions: int | None) -> _Columns | _Python:
    if isinstance(program, PandasVertexProgram):
        return _Python(graph, program, edges, degrees, count)
    if program.summed is None:
        return _Columns(graph, program, edges, degrees, count)
    total, most = _sizes(degrees)
    # A task costs more than its arrays do, so that the shuffle partitions would be too many.
    parts = partitions or max(edges.sparkSession.sparkContext.defaultParallelism, (total + graph.vertices.count()) // ARRAY_ROWS + 1)
    # The edges of a source that is large for a part can't be spread as arrays.
    return _Columns(graph, program, edges, degrees, count) if most > max(PLAIN, total // (4 * parts)) else _Arrays(graph, program, edges, parts)


def _sizes(degrees: DataFrame) -> tuple[int, int]:
    """The number of edges, and the most that a source has."""
    row = degrees.agg(F.sum("out_degree").alias("all"), F.max("out_degree").alias("most")).first()
    return row["all"] or 0, row["most"] or 0


class _Columns:
    """Supersteps of a program of column expressions."""

    def __init__(self, graph: Graph, program: VertexProgram, edges: DataFrame, degrees: DataFrame, count: int):
        self._begin(graph, program, count)
        if program.ordered:
            edges = edges.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy("dst", "value")) - 1)
        total, most = _sizes(degrees)
        self.fair = max(PLAIN, total // (4 * count))
        self.heavy: DataFrame | None = None
        if most > self.fair:
            # 4 * count at most, as each has more than a 4 * count'th part of all edges.
            large = F.broadcast(degrees.where(F.col("out_degree") > self.fair).select(F.col("id").alias("src")))
            self.heavy = edges.join(large, "src", "left_semi").repartition(count, "dst").persist(StorageLevel.MEMORY_AND_DISK)
            edges = edges.join(large, "src", "left_anti")
        self.light = edges.repartition(count, "src").sortWithinPartitions("src").persist(StorageLevel.MEMORY_AND_DISK)
        self.light.count()  # its partitioning is known to later plans once it is there

    def _begin(self, graph: Graph, program: VertexProgram, count: int) -> None:
        self.graph, self.program, self.count = graph, program, count
        self.step: Step | None = None
        self.value_type = graph.vertices.schema["value"].dataType

    def deal(self, state: DataFrame) -> None:
        """Before the first superstep, with the state in its parts."""

    def inbox(self, messages: DataFrame) -> DataFrame:
        """dst, received, in_name for each of combine: what has arrived at a vertex."""
        return messages.groupBy("dst").agg(F.count("*").alias("received"), *[how(F.col("src"), F.col("message")).alias(f"in_{name}") for name, how in self.program.combine.items()])

    def superstep(self, state: DataFrame, messages: DataFrame | None, superstep: int, known: dict[str, Any]) -> DataFrame:
        combine = self.program.combine
        state = state.select("id", "active", "out_degree", "value")
        if messages is None:
            rows = state.select("*", F.lit(None).cast("long").alias("received"), *[self._empty(name).alias(f"in_{name}") for name in combine])
        else:
            inbox = self.inbox(messages)
            rows = state.join(inbox, state["id"] == inbox["dst"], "left").drop("dst")
        self.step = step = self.program.compute(Context(superstep, known))
        step.contribute = {named(self.program.aggregators, n): c for n, c in step.contribute.items()}
        runs = F.col("active") | F.col("received").isNotNull()
        targets = {} if step.targets is None else {"targets": F.when(F.col("runs"), step.targets)}
        if step.skip is not None:
            if not self.program.ordered:
                raise ValueError("steps that skip out-edges need a program with ordered = True")
            targets["skip"] = _column(step.skip).cast("long")
        sends = (F.col("runs") & _column(step.send)) if step.message is not None else F.lit(False)
        ran = rows.withColumn("runs", runs)
        value = F.col("value") if step.value is None else F.when(F.col("runs"), step.value.cast(self.value_type)).otherwise(F.col("value"))
        return ran.select(
            "id",
            (F.col("runs") & ~F.coalesce(_column(step.halt), F.lit(False))).alias("active"),
            "out_degree",
            value.alias("value"),
            "runs",
            F.coalesce("received", F.lit(0)).cast("long").alias("received"),
            F.coalesce(sends, F.lit(False)).alias("sends"),
            *[c.alias(n) for n, c in targets.items()],
            *[F.when(F.col("runs"), c).alias(f"to_{n}") for n, c in step.contribute.items()],
        )

    def _empty(self, name: str) -> Column:
        """A null of the type that combine gives, by asking Spark for it."""
        frame = self.graph.vertices.sparkSession.range(0).select(F.lit(0).cast("long").alias("src"), F.lit(None).cast(self.program.message_type).alias("message"))
        made = frame.agg(self.program.combine[name](F.col("src"), F.col("message")).alias("x")).schema["x"].dataType
        return F.lit(None).cast(made)

    def measures(self) -> list[Column]:
        """Counters and aggregates, to be observed while the superstep is written."""
        given = self.step.contribute
        unknown = given.keys() - self.program.aggregators.keys()
        if unknown:
            raise KeyError(f"no such aggregators: {sorted(unknown)}")
        along = F.col("out_degree") if self.step.skip is None else F.greatest(F.lit(0), F.col("out_degree") - F.greatest(F.lit(0), F.col("skip")))
        sent = F.sum(F.when(F.col("sends"), along).otherwise(0))
        if self.step.targets is not None:
            sent = sent + F.sum(F.coalesce(F.size("targets"), F.lit(0)))
        plain = {n: a for n, a in self.program.aggregators.items() if n in given and not isinstance(a, FoldAggregator)}
        return [F.count_if("active").alias("active"), F.count_if("runs").alias("computed"), F.sum("received").alias("received"), sent.alias("sent"), *[a.expression(F.col(f"to_{n}")).alias(f"to_{n}") for n, a in plain.items()]]

    def aggregates(self, row: dict[str, Any], state: DataFrame) -> dict[str, Any]:
        """What vertices read in the next superstep."""
        given, values = self.step.contribute, {}
        for n, a in self.program.aggregators.items():
            found = a.over(state.select(f"to_{n}")) if isinstance(a, FoldAggregator) and n in given else row.get(f"to_{n}")
            values[n] = a.init if found is None else found
        return values

    def messages(self, state: DataFrame) -> DataFrame | None:
        """src, dst, message of what the last superstep has sent."""
        parts = []
        if self.step.message is not None:
            skips = ["skip"] if self.step.skip is not None else []
            senders = state.where("sends").select("id", "out_degree", F.col("value").alias("vertex_value"), *skips)
            value = self.step.message(Row(id=F.col("id"), value=F.col("vertex_value"), out_degree=F.col("out_degree")), Row(src=F.col("src"), dst=F.col("dst"), value=F.col("edge_value")))
            sides = [(senders, self.light)]
            if self.heavy is not None:
                sides.append((F.broadcast(senders.where(F.col("out_degree") > self.fair)), self.heavy))
            for some, edges in sides:
                along = edges.withColumnRenamed("value", "edge_value")
                joined = some.join(along, some["id"] == along["src"])
                if skips:
                    joined = joined.where("place >= skip")
                parts.append(joined.select("src", "dst", value.cast(self.program.message_type).alias("message")))
        if self.step.targets is not None:
            parts.append(state.where("targets IS NOT NULL").select(F.col("id").alias("src"), F.inline("targets")).select("src", F.col("dst").cast("long").alias("dst"), F.col("value").cast(self.program.message_type).alias("message")))
        if not parts:
            return None
        return reduce(DataFrame.unionByName, parts)

    def clear(self) -> None:
        self.light.unpersist()
        if self.heavy is not None:
            self.heavy.unpersist()


def _column_of(batches: list[pa.RecordBatch], name: str, null: Any, kind: Any) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *[b.column(name).fill_null(null).to_numpy(zero_copy_only=False) for b in batches]])


def _held(found: pa.Array, row: int, kind: Any) -> np.ndarray:
    return np.frombuffer(found[row].as_buffer(), kind)


class _Arrays(_Columns):
    """Supersteps of a program whose vertices send one number along all their out-edges and read the sum of what arrives.

    The edges from one part to another lie as places of their sources, by destination. A part's task puts its numbers there, sums
    those for one destination, and sends each part one row; that part's task adds up what comes from all parts. The rows of a part
    go by the id of one of its vertices. A part has some ARRAY_ROWS vertices and edges, so that the number of parts grows with the graph.
    """

    SENDING = "id long, sources binary, places binary, starts binary, cuts binary, targets binary"
    READING = "id long, parts binary, each binary, dsts binary, slots binary, all binary"

    def __init__(self, graph: Graph, program: VertexProgram, edges: DataFrame, count: int):
        self._begin(graph, program, count)
        self.edges = edges
        ship_by_value(program)

    def deal(self, state: DataFrame) -> None:
        count = self.count
        part = lambda c: F.pmod(F.hash(c), F.lit(count))  # noqa: E731 - where repartition puts it
        heads = np.full(count, -1, np.int64)
        there = np.zeros(count, bool)
        for p, head in state.groupBy(part("id").alias("part")).agg(F.min("id")).collect():
            heads[p], there[p] = head, True
        kind = f"sends boolean, {self.SENDING}, part int, counts binary, dsts binary"
        arrow = state.sparkSession.createDataFrame([], kind).limit(0).toArrow().schema

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            batches = list(batches)
            src, dst = _column_of(batches, "src", 0, np.int64), _column_of(batches, "dst", 0, np.int64)
            own, to = _column_of(batches, "own", 0, np.int32), _column_of(batches, "to", 0, np.int32)
            if not len(src) or not there[own[0]]:
                return
            kept = there[to]  # the others' destinations aren't there
            src, dst, to = src[kept], dst[kept], to[kept]
            if not len(src):
                return
            order = np.lexsort((dst, to))
            sources, places = np.unique(src[order], return_inverse=True)
            dst, to = dst[order], to[order]
            starts = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
            counts, dst, to = np.diff(np.r_[starts, len(dst)]), dst[starts], to[starts]
            cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            targets, p = heads[to[cuts]], int(own[0])
            cuts = np.r_[cuts, len(dst)]
            made = [{"sends": True, "id": int(heads[p]), "part": p, "sources": sources.tobytes(), "places": places.astype(np.int32).tobytes(), "starts": starts.tobytes(), "cuts": cuts.tobytes(), "targets": targets.tobytes()}]
            made += [{"sends": False, "id": int(t), "part": p, "counts": counts[a:b].tobytes(), "dsts": dst[a:b].tobytes()} for t, a, b in zip(targets, cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_pylist(made, schema=arrow)

        reading = state.sparkSession.createDataFrame([], self.READING).limit(0).toArrow().schema

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["part"])
            if rows:
                dsts, slots = np.unique(np.frombuffer(b"".join(r["dsts"] for r in rows), np.int64), return_inverse=True)
                counts = np.bincount(slots, np.frombuffer(b"".join(r["counts"] for r in rows), np.int64)).astype(np.int64)
                parts = np.array([r["part"] for r in rows], np.int32)
                yield pa.RecordBatch.from_pylist([{"id": rows[0]["id"], "parts": parts.tobytes(), "each": b"".join(r["counts"] for r in rows), "dsts": dsts.tobytes(), "slots": slots.astype(np.int32).tobytes(), "all": counts.tobytes()}], schema=reading)

        edges = self.edges.select("src", "dst", part("src").cast("int").alias("own"), part("dst").cast("int").alias("to"))
        both = edges.repartition(count, "src").mapInArrow(dealt, kind).persist(StorageLevel.MEMORY_AND_DISK)
        names = [f.split()[0] for f in self.SENDING.split(", ")]
        self.sending = both.where("sends").select(*names, "part").repartition(count, "id").persist(StorageLevel.MEMORY_AND_DISK)
        self.reading = both.where("NOT sends").select("id", "part", "dsts", "counts").repartition(count, "id").mapInArrow(merged, self.READING).repartition(count, "id").persist(StorageLevel.MEMORY_AND_DISK)
        self.sending.count()
        self.reading.count()
        both.unpersist()

    def messages(self, state: DataFrame) -> DataFrame | None:
        """id of a vertex of the part they go to, the part they come from, and what it sends, by destination."""
        if self.step.targets is not None or self.step.skip is not None:
            raise ValueError("programs with summed send along all out-edges only")
        if self.step.message is None:
            return None
        value = self.step.message(Row(id=F.col("id"), value=F.col("value"), out_degree=F.col("out_degree")), Row())
        # Vertices without out-edges never come to their message.
        told = state.select("id", "sends", F.when(F.col("sends") & (F.col("out_degree") > 0), value.cast("double")).alias("message"))
        rows = told.join(self.sending.withColumnRenamed("id", "head"), told["id"] == F.col("head"), "left").drop("head")
        kind = "id long, part int, sums binary, sent binary, given binary"
        arrow = state.sparkSession.createDataFrame([], kind).limit(0).toArrow().schema

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            batches = list(batches)
            known = next(((b, k) for b in batches if b.column("sources").null_count < b.num_rows for k in np.flatnonzero(b.column("sources").is_valid().to_numpy(zero_copy_only=False))), None)
            if known is None:
                return
            held = lambda name, of: _held(known[0].column(name), int(known[1]), of)
            sources, places, starts, cuts, targets = held("sources", np.int64), held("places", np.int32), held("starts", np.int64), held("cuts", np.int64), held("targets", np.int64)
            ids = _column_of(batches, "id", 0, np.int64)
            order = np.argsort(ids, kind="stable")
            at = order[np.minimum(np.searchsorted(ids, sources, sorter=order), len(ids) - 1)]
            sent = (ids[at] == sources) & _column_of(batches, "sends", False, bool)[at]
            given = sent & np.concatenate([b.column("message").is_valid().to_numpy(zero_copy_only=False) for b in batches])[at]
            sums = np.add.reduceat(np.where(given, _column_of(batches, "message", 0.0, np.float64)[at], 0.0)[places], starts)
            # Numbers of messages go along only where some aren't sent or are null.
            each = [None if given.all() else np.add.reduceat(x[places].astype(np.int64), starts) for x in (sent, given)]
            cut = lambda x: [None if x is None else x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            own = known[0].column("part")[int(known[1])].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((targets, [own] * len(targets), cut(sums), cut(each[0]), cut(each[1])), arrow, strict=True)], schema=arrow)

        return rows.mapInArrow(send, kind)

    def inbox(self, messages: DataFrame) -> DataFrame:
        rows = messages.repartition(self.count, "id").groupBy("id").agg(F.collect_list(F.struct("part", "sums", "sent", "given")).alias("blocks"))
        rows = rows.join(self.reading, "id").select("blocks", "parts", "each", "dsts", "slots", "all")
        kind = f"dst long, received long, in_{self.program.summed} double"
        arrow = rows.sparkSession.createDataFrame([], kind).limit(0).toArrow().schema

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    held = lambda name, of: _held(batch.column(name), k, of)  # noqa: B023, E731
                    dsts, slots, full, parts = held("dsts", np.int64), held("slots", np.int32), held("all", np.int64), held("parts", np.int32)
                    # A block lies where the part that it comes from does among all that send here.
                    blocks = sorted(batch.column("blocks")[k].as_py(), key=lambda b: b["part"])
                    if [b["part"] for b in blocks] != parts.tolist():
                        raise RuntimeError("a part's messages are missing")
                    sums = np.bincount(slots, np.frombuffer(b"".join(b["sums"] for b in blocks), np.float64), len(dsts))
                    received = given = full
                    if any(b["sent"] is not None for b in blocks):
                        begins = np.cumsum([0, *[len(b["sums"]) for b in blocks]])
                        each = held("each", np.uint8).tobytes()  # as many bytes as sums
                        of = lambda name: np.frombuffer(b"".join(each[a : a + len(b["sums"])] if b[name] is None else b[name] for a, b in zip(begins, blocks, strict=False)), np.int64)  # noqa: B023, E731
                        received, given = (np.rint(np.bincount(slots, of(name), len(dsts))).astype(np.int64) for name in ("sent", "given"))
                    kept = received > 0
                    yield pa.RecordBatch.from_arrays([pa.array(dsts[kept]), pa.array(received[kept]), pa.array(sums[kept], mask=given[kept] == 0)], schema=arrow)

        return rows.mapInArrow(read, kind)

    def clear(self) -> None:
        self.sending.unpersist()
        self.reading.unpersist()


class _Python:
    """Supersteps of a program in Python."""

    def __init__(self, graph: Graph, program: PandasVertexProgram, edges: DataFrame, degrees: DataFrame, count: int):
        self.program, self.count = program, count
        edges = edges.groupBy("src").agg(F.collect_list(F.struct("dst", "value")).alias("edges"))
        self.edges = edges.repartition(count, "src").persist(StorageLevel.MEMORY_AND_DISK)
        self.edges.count()

    def superstep(self, state: DataFrame, messages: DataFrame | None, superstep: int, known: dict[str, Any]) -> DataFrame:
        program = self.program
        state = state.select("id", "active", "out_degree", "value")
        kind = f"array<struct<src:bigint,value:{program.message_type}>>"
        if messages is None:
            rows = state.withColumn("inbox", F.lit(None).cast(kind))
        else:
            inbox = messages.groupBy("dst").agg(F.collect_list(F.struct("src", F.col("message").alias("value"))).alias("inbox"))
            rows = state.join(inbox, state["id"] == inbox["dst"], "left").drop("dst")
        edges = self.edges
        rows = rows.join(edges, rows["id"] == edges["src"], "left").drop("src")
        schema = f"id long, active boolean, out_degree long, value {program.value_type}, runs boolean, received long, sent array<struct<dst:bigint,value:{program.message_type}>>, given array<struct<name:string,value:{program.contribution_type}>>"
        arrow = rows.sparkSession.createDataFrame([], schema).limit(0).toArrow().schema

        def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    inbox = r["inbox"] or []
                    runs = r["active"] or bool(inbox)
                    row = {"id": r["id"], "active": False, "out_degree": r["out_degree"], "value": r["value"], "runs": runs, "received": len(inbox), "sent": [], "given": []}
                    if runs:
                        vertex = Vertex(r["id"], r["value"], [(m["src"], m["value"]) for m in inbox], [(e["dst"], e["value"]) for e in r["edges"] or []], superstep, known)
                        program.compute(vertex)
                        row |= {"active": not vertex.halted, "value": vertex.value, "sent": [{"dst": d, "value": v} for d, v in vertex.sent], "given": [{"name": n, "value": v} for n, v in vertex.contributions]}
                    out.append(row)
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

        ship_by_value(program)
        return rows.select("id", "active", "out_degree", "value", "inbox", "edges").mapInArrow(compute, schema)

    def deal(self, state: DataFrame) -> None:
        """Before the first superstep, with the state in its parts."""

    def measures(self) -> list[Column]:
        return [F.count_if("active").alias("active"), F.count_if("runs").alias("computed"), F.sum("received").alias("received"), F.sum(F.size("sent")).alias("sent")]

    def aggregates(self, row: dict[str, Any], state: DataFrame) -> dict[str, Any]:
        given = state.select(F.inline("given"))
        return {n: a.over(given.where(F.col("name") == n).select("value")) for n, a in self.program.aggregators.items()}

    def messages(self, state: DataFrame) -> DataFrame:
        return state.select(F.col("id").alias("src"), F.inline("sent")).select("src", "dst", F.col("value").alias("message"))

    def clear(self) -> None:
        self.edges.unpersist()
