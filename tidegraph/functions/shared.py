"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder set as the context's; where neither is there, in local mode alone, one of our own.

    On a cluster a folder of the driver would be another one on each machine, so that it is an error there.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir (or --scratch) to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidegraph-"))
        folder = context.getCheckpointDir()
    return folder


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path; after the session has ended nothing is left to delete with."""
    if spark.sparkContext._jsc is None:
        return
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the gateway is gone at interpreter exit
        return


def settle(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Writes a frame to the shared folder and reads it again, which cuts its lineage; the path is removed at exit at the latest."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tidegraph-{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
