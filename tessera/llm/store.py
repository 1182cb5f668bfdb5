"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.  Where the session names none, a temporary folder if it runs in one process (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_noting: list[list[str]] = []


@contextlib.contextmanager
def noted(paths: list[str]) -> Iterator[None]:
    """Collects in ``paths`` what is written meanwhile, for a drop once no plan reads it any more."""
    _noting.append(paths)
    try:
        yield
    finally:
        _noting.pop()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """Write a table to the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    # most columns are hashes, which no dictionary makes smaller
    df.write.option("compression", "zstd").option("parquet.enable.dictionary", "false").parquet(path)
    for paths in _noting[-1:]:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, made: list[str] | None = None) -> DataFrame:
    """The table as written; its path goes to ``made``, for a later drop."""
    out, path = written(df)
    if made is not None:
        made.append(path)
    return out


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove tables that no later plan reads."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let the driver's collector run, after which Spark removes the shuffle files that no plan refers to any more.

    What a plan holds goes in a second round, once the listeners have let go of
    the query that used it.
    """
    for pause in (0.3, 0.1):
        spark._jvm.System.gc()
        time.sleep(pause)
