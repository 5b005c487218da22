"""Cutting lineage: intermediate tables written to the cluster's shared folder.

A written Parquet table survives lost executors, is read back with only the columns a
branch needs, and gives the planner a real size, so broadcasts are decided from bytes on
disk. The folder is the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import gc
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_LOCAL: dict[str, str] = {}
_OPEN = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; a temporary one only where Spark runs in local mode."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", context.master):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="ledgerloom-")
    return _LOCAL[context.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/ledgerloom/{app}/{label}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Remove every table this application has put into the shared folder, once nothing reads them any more."""
    folder = f"{shared_dir(spark).rstrip('/')}/ledgerloom/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if paths:
        release(spark)


def forget(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` returned, once nothing reads them any more, and shuffle files that nothing holds."""
    if tables:
        _remove(tables[0].sparkSession, [table.scratch_path for table in tables])


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread materializes inside are removed at the end, for work that stores its results elsewhere."""
    open_ = _OPEN.__dict__.setdefault("made", [])
    open_.append([])
    try:
        yield
    finally:
        _remove(spark, open_.pop())


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing holds: it learns of them when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None, **options: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads it back; ``options`` go to the Parquet writer."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**options).parquet(path, partitionBy=partition_by)
    found = spark.read.schema(df.schema).parquet(path)
    found.scratch_path = path
    if made := _OPEN.__dict__.get("made"):
        made[-1].append(path)
    return found
