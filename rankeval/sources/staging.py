"""Write an intermediate result once so that several later passes can read it."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F


def _folder(spark: SparkSession) -> str | None:
    """The checkpoint folder, set up on first use; None on a cluster that names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            return None
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="rankeval-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table that is written and read back."""
    folder = _folder(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` and continue from the copy.

    Used where a reduced result (counts per score, a contingency table) feeds several passes: the wide input is
    read once, plans stay short, and a lost executor costs a re-read instead of a recomputation.  The folder is
    the one named in ``spark.checkpoint.dir``.  Where none is set, a local session gets a folder of its own and
    a cluster keeps the rows in executor storage with their lineage.
    """
    if _folder(df.sparkSession) is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """As :func:`stage`, as a Parquet table: smaller on disk than a checkpoint where rows have many numbers."""
    spark = df.sparkSession
    if _folder(spark) is None:
        return stage(df)
    df.write.parquet(path := scratch_path(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that :func:`written` made, when all that reads it has been written in turn.  Tables that lie
    elsewhere, or that were not written for want of a folder, are left alone."""
    spark = df.sparkSession
    folder = _folder(spark)
    paths = {f.rpartition("/")[0] for f in df.inputFiles()} if folder is not None else set()
    for path in paths:
        parent, _, name = path.rpartition("/")
        if parent.rpartition("/")[2] == folder.rpartition("/")[2] and re.fullmatch(r".*-[0-9a-f]{32}", name):
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints that no table refers to any more.

    It does so when the driver's garbage is collected, which may be long after a step that wrote much has been staged.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small(df: DataFrame, limit: int = 10_000) -> DataFrame:
    """Stage a lookup table and mark it for broadcast if it has at most ``limit`` rows.

    The planner cannot know that counts per position or edges per feature are few; without the mark it would
    shuffle the big side by a handful of keys.  Larger tables come back unmarked and are joined by shuffle.
    """
    staged = stage(df)
    return F.broadcast(staged) if staged.limit(limit + 1).count() <= limit else staged


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input with fewer splits than cores (one small file, say); larger inputs stay as they
    are, so nothing is shuffled where it would cost."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
