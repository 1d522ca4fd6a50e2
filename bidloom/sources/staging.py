"""Intermediate tables written to the folder the cluster shares.

A written table cuts lineage, survives the loss of an executor, and gives the
planner real file sizes: a later join broadcasts it only while the files are
under ``spark.sql.autoBroadcastJoinThreshold``. Above that the join shuffles
both sides and adaptive execution splits skewed partitions.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITION_ID = "_layout_part"


def shared_folder(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="bidloom-"))
    return context.getCheckpointDir()


_RUN: ContextVar[str] = ContextVar("run", default="bidloom")


@contextmanager
def run_folder(spark: SparkSession, name: str | None = None) -> Iterator[str]:
    """Keep the tables staged inside the block in one folder; yields its path.

    The tables outlive the block, since lazy results read them. ``drop_folder``
    removes them once the results are written.
    """
    token = _RUN.set(f"bidloom/{name or uuid.uuid4().hex}")
    try:
        yield f"{shared_folder(spark).rstrip('/')}/{_RUN.get()}"
    finally:
        _RUN.reset(token)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a run folder with all its tables."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{_RUN.get()}/{label}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once and return it as a table scan."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Write independent tables as concurrent jobs, so that none waits for the tail of another."""
    if not tables:
        return {}
    with ThreadPoolExecutor(max_workers=min(len(tables), 8)) as pool:
        jobs = {name: pool.submit(copy_context().run, stage_table, df, name) for name, df in tables.items()}
        return {name: job.result() for name, job in jobs.items()}


def measured(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` for a join: both sides are shuffled if its rows, of about so many bytes, exceed the broadcast threshold.

    The planner knows the files of a written table only. Where values repeat
    these are a hundredth of the rows, which a broadcast gathers in the driver.
    """
    most = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return df.hint("merge") if df.count() * row_bytes > most else df


def attach(df: DataFrame, lookup: DataFrame, keys: list[str], label: str = "lookup") -> DataFrame:
    """Left-join per-key values onto rows.

    ``lookup`` holds one row per key. It is written first, so the broadcast
    decision rests on measured size; a row with a null key matches nothing.
    """
    return df.join(stage_table(lookup, label), keys, "left")


def range_layout(df: DataFrame, order: list, label: str = "layout") -> DataFrame:
    """Range-partition by ``order`` and keep each row's partition number.

    The layout is written, so every later pass sees the same numbers. The order
    must be total (end it with a unique column): then even a value shared by a
    third of all rows is spread over partitions.
    """
    ranged = df.repartitionByRange(*order).withColumn(PARTITION_ID, F.spark_partition_id())
    return stage_table(ranged, label)
