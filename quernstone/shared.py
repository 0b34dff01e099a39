"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_made: set[str] = set()
#: ``passing``: the tables of each passing() that this thread is in.
_here = threading.local()


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, as in tests, a local folder on a local master alone."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (shared or "file:///tmp/checkpoints").rstrip("/")


def session_folder(spark: SparkSession) -> str:
    """This application's folder below shared_root(), which goes when the driver ends."""
    folder = f"{shared_root(spark)}/quernstone/{spark.sparkContext.applicationId}"
    if folder not in _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _made.add(folder)
    return folder


def store(df: DataFrame, name: str) -> str:
    """The folder into which ``df`` was written once, below session_folder()."""
    folder = f"{session_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    for tables in getattr(_here, "passing", [])[-1:]:
        tables.append((df.sparkSession, folder))
    return folder


@contextmanager
def passing() -> Iterator[None]:
    """Tables that store() writes inside are deleted at its end; what is to stay is written elsewhere by then."""
    _here.passing = [*getattr(_here, "passing", []), []]
    try:
        yield
    finally:
        for spark, folder in _here.passing.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once into the shared folder and read from there."""
    return df.sparkSession.read.schema(df.schema).parquet(store(df, name))


def spread(table: DataFrame) -> DataFrame:
    """A scanned table in no fewer partitions than there are cores; only tables of a few small files are shuffled."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table._jdf.queryExecution().toRdd().getNumPartitions() >= cores else table.repartition(cores)
