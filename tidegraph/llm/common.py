"""What the operators of this subpackage share: tables, Arrow batches and the shared folder."""

from __future__ import annotations

import atexit
import ctypes
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shared
from ..functions.shared import remove, shared_folder
from ..functions.shipping import ship_by_value

#: Rows and bytes of one Arrow batch. Texts may be very long, so that a worker holds few of them at once.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20

#: Rows of a table of a few numbers up to which it is broadcast, or may lie in one task as a whole: some 10 MB.
FEW = 200_000

#: The part of all rows, as 1/HUBS, from which on a key is joined apart.
HUBS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_column(name: str = "text"):
    """A text column in which null is the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Runs a function of one Arrow batch over a frame; it keeps nothing between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)

    return map_partitions(df, run, schema)


def map_partitions(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Runs a function of the Arrow batches of a partition over a frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    ship_by_value()
    limit_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns freed memory to the system: workers are used again by later stages, with others beside them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def give_back_heap(spark: SparkSession) -> None:
    """Has the executors' JVMs collect their garbage, upon which they return freed heap to the system: Python workers need room beside them.

    A JVM keeps what earlier stages made its heap grow to, without need. One task for each core; which executor takes it is Spark's affair.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).selectExpr("reflect('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()


def limit_batches(spark: SparkSession) -> None:
    """Sets the session's limits of Arrow batches to ours. Plans read them when they are executed, so that they stay."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def worker_state() -> dict:
    """What a Python worker keeps between tasks. Functions come to it by value, so their own module's globals don't last."""
    module = sys.modules.setdefault("_tidegraph_worker", types.ModuleType("_tidegraph_worker"))
    return module.__dict__.setdefault("state", {})


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/tidegraph-{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def settle(df: DataFrame, label: str) -> DataFrame:
    """Writes a frame as a table of the shared folder and reads it again: what is computed once survives lost executors."""
    return shared.settle(df, label)[0]


def spread(df: DataFrame) -> DataFrame:
    """Marks a table for joins by shuffling.

    Spark estimates tables by the bytes of their compressed files, and doesn't count the rows that an array is made into: it would
    take tables of a hundred times its limit for small ones and broadcast them through the driver.
    """
    return df.hint("merge")


def few(count: int) -> bool:
    """Whether count rows of a few numbers may go through the driver."""
    return count <= FEW


def unless_many(df: DataFrame, count: int) -> DataFrame:
    """A table of count rows, which is joined as Spark likes up to FEW rows, and by shuffling beyond."""
    return df if few(count) else spread(df)


def if_few(df: DataFrame, count: int) -> DataFrame:
    """Marks a table of count rows of a few numbers for broadcasting if they are FEW at most; else for joins by shuffling."""
    return F.broadcast(df) if few(count) else spread(df)


def if_small(df: DataFrame) -> DataFrame:
    """Marks a settled table of a few numbers a row for broadcasting if it has no more than FEW rows; else for joins by shuffling."""
    return if_few(df, df.count())


def join_unique(rows: DataFrame, unique: DataFrame, key: str, count: int) -> DataFrame:
    """rows joined with a table that has one row per key and, as n, how many of the count rows have it.

    Keys with more than 1/HUBS of the rows, which are HUBS at most, are joined by broadcasting, so that no key's rows meet in one
    task. Of FEW rows in all there is nothing to spread.
    """
    if count <= FEW:
        return rows.join(unique.drop("n"), key)
    hubs = F.broadcast(unique.where(F.col("n") * HUBS > count).drop("n"))
    light = rows.join(hubs.select(key), key, "left_anti").join(spread(unique.where(F.col("n") * HUBS <= count).drop("n")), key)
    return light.unionByName(rows.join(hubs, key))


class Scratch:
    """Tables of one computation, removed once it is over."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def settle(self, df: DataFrame, label: str) -> DataFrame:
        made, path = shared.settle(df, label)
        self.paths.append(path)
        return made

    def release(self) -> None:
        """Lets Spark remove the shuffle files of jobs that are over: it does so when the driver collects its garbage."""
        self.spark.sparkContext._jvm.System.gc()

    def clear(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths = []
