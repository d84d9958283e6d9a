"""Lineage cuts: intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_marked: set[str] = set()
#: What the last step of each application wrote on its way, and the list that the running step adds to.
_passing: dict[str, list[str]] = {}
_adding: list[list[str]] = []


def folder(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the application ends.

    Where the setting is absent a temporary folder takes its place, but only if driver and executors
    are one process: on a cluster executors would not see each other's files.
    """
    root = spark.conf.get(SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='webgrain-')}"
        spark.conf.set(SETTING, root)
    own = f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"
    if own not in _marked:
        jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(hadoop)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _marked.add(own)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _adding:
        _adding[-1].append(path)
    return path


@contextmanager
def step(spark: SparkSession) -> Iterator[None]:
    """One of several steps, each of which begins after the result of the one before is written: the tables that led to that result go."""
    own, jvm = spark.sparkContext.applicationId, spark.sparkContext._jvm
    for gone in _passing.pop(own, []):
        path = jvm.org.apache.hadoop.fs.Path(gone)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _adding.append(_passing.setdefault(own, []))
    try:
        yield
    finally:
        _adding.pop()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and return the written table.

    A lost executor then costs a re-read of files instead of the whole lineage, and
    branches that share df compute it once.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
