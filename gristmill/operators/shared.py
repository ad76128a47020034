"""Intermediate results in the folder that all executors share."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a local one, but only with a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: the executors need a shared folder")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="gristmill-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """The same rows from the shared folder: computed once, and not again when an executor is lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows as a compressed table in the shared folder, for what is as large as the input and read several times."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitioned(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows, written hash-partitioned by the keys; joins and aggregations on them do not shuffle these rows again.

    Adaptive execution does not hand on how its result is partitioned, so it is off for this one write.
    """
    spark = df.sparkSession
    shared_folder(spark)
    adaptive = "spark.sql.adaptive.enabled"
    was = spark.conf.get(adaptive)
    spark.conf.set(adaptive, "false")
    try:
        return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).checkpoint(eager=True)
    finally:
        spark.conf.set(adaptive, was)


def delete(spark: SparkSession, path: str) -> bool:
    """Removes a file or folder of any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it does not exist."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def retried(attempts: int = 3, wait_seconds: float = 0.1) -> Callable:
    """Decorator for driver-side calls to outside systems (tasks are tried again by Spark): up to ``attempts`` calls, the last error is raised."""

    def around(call: Callable) -> Callable:
        @wraps(call)
        def run(*args, **named):
            for n in range(1, attempts + 1):
                try:
                    return call(*args, **named)
                except Exception:
                    if n == attempts:
                        raise
                    time.sleep(wait_seconds * n)

        return run

    return around


def timed(call: Callable) -> Callable:
    """Decorator that prints how long a call took, as h:mm:ss.mmm; the call's own result is returned."""

    @wraps(call)
    def run(*args, **named):
        start = time.perf_counter()
        try:
            return call(*args, **named)
        finally:
            ms = round((time.perf_counter() - start) * 1000)
            print(f"{call.__name__} took {ms // 3_600_000}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}")

    return run
