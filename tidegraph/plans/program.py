"""What one vertex does in a superstep: as column expressions, or as a Python function.

Expressions are the first choice: Catalyst sees them, messages are combined before they are shuffled, and nothing leaves
the JVM. A PandasVertexProgram gets each vertex with its single messages and out-edges; it can do anything, but a vertex
with very many messages or edges is one row there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.aggregators import Aggregator, FoldAggregator

if TYPE_CHECKING:
    from .graph import Graph
    from .superstep import Result


@dataclass
class Step:
    """What the running vertices do. Columns are over a vertex's row; plain values hold for all vertices.

    value: the new value (None: as it was). halt: whether to vote to halt. message: a function of the vertex's and the edge's
    row that gives the value sent along each out-edge (None: nothing is sent); send: which vertices send it. targets: an
    array<struct<dst, value>> of further messages to any vertices. skip: how many of a vertex's out-edges, in their order by dst and
    value, message and send pass over (for programs with ordered = True). contribute: contributions to aggregators by
    name or by index.
    """

    value: Column | None = None
    halt: Column | bool = False
    message: Callable[[Row, Row], Column] | None = None
    send: Column | bool = True
    targets: Column | None = None
    contribute: dict[str | int, Column] = field(default_factory=dict)
    skip: Column | int | None = None


class Row:
    """Columns of one side of a join by name: v.id, v.value, e.dst, e.value."""

    def __init__(self, **columns: Column):
        self._columns = columns

    def __getattr__(self, name: str) -> Column:
        try:
            return self._columns[name]
        except KeyError:
            raise AttributeError(name) from None


@dataclass
class Context:
    """A running vertex: columns, and what is known to all vertices as plain values."""

    superstep: int
    globals: dict[str, Any]
    id: Column = field(default_factory=lambda: F.col("id"))
    value: Column = field(default_factory=lambda: F.col("value"))
    out_degree: Column = field(default_factory=lambda: F.col("out_degree"))

    def inbox(self, name: str) -> Column:
        """What combine made of the messages; null if there were none."""
        return F.col(f"in_{name}")

    @property
    def has_messages(self) -> Column:
        return F.coalesce(F.col("received"), F.lit(0)) > 0

    @property
    def received(self) -> Column:
        """How many messages have arrived."""
        return F.coalesce(F.col("received"), F.lit(0)).cast("long")

    def aggregate(self, name: str | int) -> Any:
        """What the vertices contributed in the last superstep, a plain value."""
        return self.globals[named(self.globals, name)]


def named(aggregators: dict[str, Any], name: str | int) -> str:
    """An aggregator's name from its name or its index, which is its place in the program's aggregators."""
    return list(aggregators)[name] if isinstance(name, int) else name


class Hooks:
    """What a program may do before its first superstep and after its last, on the driver."""

    def init(self, graph: Graph) -> None:
        """Before the first superstep."""

    def term(self, result: Result) -> None:
        """After the last superstep."""


class VertexProgram(Hooks):
    """Subclasses give combine and aggregators, and compute()."""

    #: How an inbox is reduced: aggregate expressions by name, over the message's source and value.
    combine: dict[str, Callable[[Column, Column], Column]] = {}
    aggregators: dict[str, Aggregator | FoldAggregator] = {}
    message_type = "double"
    #: Whether steps skip out-edges, so that they need an order; a vertex's edges are then sorted in one task.
    ordered = False
    #: The name of combine's only entry, if it is the sum of messages that are doubles, go along all out-edges and don't depend on the
    #: edge: parts then exchange arrays, and no row is made for an edge.
    summed: str | None = None

    def compute(self, ctx: Context) -> Step:
        raise NotImplementedError


class Vertex:
    """A vertex as Python code sees it."""

    __slots__ = ("_globals", "contributions", "halted", "id", "messages", "out_edges", "sent", "superstep", "value")

    def __init__(self, id: int, value: Any, messages: list[tuple[int, Any]], out_edges: list[tuple[int, Any]], superstep: int, globals: dict[str, Any]):
        self.id, self.value, self.messages, self.out_edges, self.superstep, self._globals = id, value, messages, out_edges, superstep, globals
        self.sent: list[tuple[int, Any]] = []
        self.contributions: list[tuple[str, Any]] = []
        self.halted = False

    def vote_to_halt(self) -> None:
        self.halted = True

    def send_to(self, dst: int, value: Any) -> None:
        self.sent.append((dst, value))

    def send_to_all_neighbors(self, value: Any) -> None:
        self.sent.extend((dst, value) for dst, _ in self.out_edges)

    def edges_from(self, k: int) -> Iterator[tuple[int, Any]]:
        """The out-edges without the first k."""
        return iter(self.out_edges[k:])

    def aggregate(self, name: str | int) -> Any:
        return self._globals[named(self._globals, name)]

    def contribute(self, name: str | int, value: Any) -> None:
        self.contributions.append((named(self._globals, name), value))


class PandasVertexProgram(Hooks):
    """compute(vertex) in Python, an Arrow batch of vertices at a time. Messages come with their source; their order is open."""

    aggregators: dict[str, FoldAggregator] = {}
    value_type = "double"
    message_type = "double"
    #: The type that all contributions have.
    contribution_type = "double"

    def compute(self, vertex: Vertex) -> None:
        raise NotImplementedError
