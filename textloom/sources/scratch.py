"""A folder for intermediate files that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder (tests, one machine).
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    """The folder from ``spark.checkpoint.dir``.

    Where the setting is absent a local folder serves, but only for a local
    master: on a cluster each machine would see a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return LOCAL_CHECKPOINTS


def hadoop_path(spark: SparkSession, path: str):
    """The JVM's path object and its file system."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the session's part of the shared folder, which goes when the application ends."""
    home = f"{shared_root(spark)}/textloom/{spark.sparkContext.applicationId}"
    folder, files = hadoop_path(spark, home)
    files.deleteOnExit(folder)
    return f"{home}/{tag}-{uuid.uuid4().hex}"


#: Files a core of tables whose rows are a few numbers.
SMALL_FILES = 4


def saved(df: DataFrame, tag: str, small: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: what is used several times is computed once.

    Lost executors cost no recomputation of what came before, and the planner sees
    true sizes, on which it bases broadcasts. As many files are written as ``df``
    has partitions; after a shuffle adaptive execution sets their number by bytes.
    Tables of a few numbers a row, made by a shuffle, are ``small``: they are
    written as a few files a core, as starting a file costs more than its rows.
    """
    path = shared_path(df.sparkSession, tag)
    if small:
        df = df.coalesce(SMALL_FILES * max(1, df.sparkSession.sparkContext.defaultParallelism))
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(*frames: DataFrame | None) -> None:
    """Delete what :func:`saved` wrote for ``frames``, which nothing will read again."""
    for frame in frames:
        path = getattr(frame, "_scratch", None)
        if path:
            folder, files = hadoop_path(frame.sparkSession, path)
            files.delete(folder, True)
