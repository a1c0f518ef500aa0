"""Cuts of the lineage, and what is stored for them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from functools import partial
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset: a temporary one of a local session, an error on a cluster."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


#: Where checkpoints of the running thread go as tables; unset: to the session's checkpoint folder.
_OWN: ContextVar[str | None] = ContextVar("own_folder", default=None)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    own = _OWN.get()
    if own is None:
        shared_folder(df.sparkSession)
        return df.checkpoint()
    path = f"{own}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(spark: SparkSession, rows: int, least: int = 10_000) -> int:
    """Tasks for rows that many short jobs run over: one for each core, but none of fewer than ``least`` rows."""
    return max(1, min(spark.sparkContext.defaultParallelism, -(-rows // least)))


def side_by_side(spark: SparkSession, jobs: list[Callable[[], T]]) -> list[T]:
    """Results of functions that run Spark jobs, each in a thread of its own, in their order: many short jobs leave most cores idle. All end before an error is passed on."""
    if len(jobs) < 2:
        return [job() for job in jobs]
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(partial(copy_context().run, job))) for job in jobs]
    return [r.result() for r in running]


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def passing_checkpoints(spark: SparkSession) -> Iterator[None]:
    """Checkpoints that this thread makes inside are tables in a folder of their own, which is removed at the end; what is needed later has to
    be stored inside. The session's checkpoint folder stays as it is, so queries beside this one aren't touched."""
    own = f"{shared_folder(spark)}/passing-{uuid.uuid4()}"
    token = _OWN.set(own)
    try:
        yield
    finally:
        _OWN.reset(token)
        remove(spark, own)
