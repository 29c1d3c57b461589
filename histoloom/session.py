"""Session helpers: table access, shared scratch space and lineage cuts."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's readers ever open the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that pass between the JVM and Python at once; texts may be long, and memory follows from this.
ROWS_AT_ONCE = 1000


def importable_on_workers(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package, and bound the batches that they get.

    On a cluster the package is shipped with ``--py-files``; this covers local sessions that were started elsewhere.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_AT_ONCE)
    env = spark.sparkContext.environment
    env.setdefault("MALLOC_ARENA_MAX", "1")  # glibc then gives free memory back to the system instead of keeping it by thread
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='histoloom-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def posix_path(uri: str) -> str:
    """The mounted path of a shared folder, for memory-mapped files."""
    if uri.startswith("file:"):
        return "/" + uri.removeprefix("file:").lstrip("/")
    if "://" in uri:
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {uri}")
    return uri


_COLLECTING: list[list[str]] = []


@contextlib.contextmanager
def scratch() -> Iterator[list[str]]:
    """The paths of the tables that are staged inside, for their release once nothing lazy rests on them."""
    paths: list[str] = []
    _COLLECTING.append(paths)
    try:
        yield paths
    finally:
        _COLLECTING.remove(paths)


def stage(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors.

    keep: the table belongs to no scratch.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    if _COLLECTING and not keep:
        _COLLECTING[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Remove staged tables; only for callers that have written what they made from them."""
    while paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
