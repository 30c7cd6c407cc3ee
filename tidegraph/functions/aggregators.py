"""Global aggregators: what all vertices contribute in one superstep is merged and read in the next.

Values don't stick: each superstep starts anew, and one without contributions gives the initial value. The initial value must be
the identity of the aggregation, as it stands in for an empty set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shipping import ship_by_value


@dataclass(frozen=True)
class Aggregator:
    """An aggregate expression over the contributions of the vertices that ran; null contributions don't count."""

    init: Any
    expression: Callable[[Column], Column]


def total(init: Any = 0.0) -> Aggregator:
    return Aggregator(init, F.sum)


def minimum(init: Any = None) -> Aggregator:
    return Aggregator(init, F.min)


def maximum(init: Any = None) -> Aggregator:
    return Aggregator(init, F.max)


def count() -> Aggregator:
    return Aggregator(0, F.count)


def avg(init: Any = None) -> Aggregator:
    return Aggregator(init, F.avg)


@dataclass(frozen=True)
class FoldAggregator:
    """An aggregation in Python: partitions are folded with accumulate, their results with merge."""

    init: Any
    accumulate: Callable[[Any, Any], Any]
    merge: Callable[[Any, Any], Any]

    def over(self, contributions: DataFrame) -> Any:
        """The merged value of a frame of one column. Only one value per partition reaches the driver."""
        init, accumulate = self.init, self.accumulate

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            value, some = init, False
            for batch in batches:
                for x in batch.column(0).to_pylist():
                    if x is not None:
                        value, some = accumulate(value, x), True
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(value)], pa.binary())], ["value"])

        ship_by_value()
        parts = contributions.mapInArrow(fold, "value binary").collect()
        return reduce(self.merge, (cloudpickle.loads(bytes(r["value"])) for r in parts), self.init)
