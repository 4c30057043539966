"""Files that tasks write and read themselves, in a folder all executors share.

A file's name holds the number of the task attempt, and the manifest that a job returns names the files of the attempts
that Spark accepted: a task that runs twice leaves files that nobody reads.
"""

from __future__ import annotations

from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession

from rankeval.sources.staging import scratch_path


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one in ``spark.checkpoint.dir``."""
    uri = scratch_path(spark, name)
    fs, path = locate(uri)
    fs.create_dir(path, recursive=True)
    return uri


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def commit(uri: str, chunks) -> int:
    """Write the byte ``chunks`` as the file ``uri``; the number of bytes."""
    fs, path = locate(uri)
    size = 0
    with fs.open_output_stream(path, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    return size


def task_file(number: int, suffix: str) -> str:
    """A name for the ``number``-th file of the running task."""
    task = TaskContext.get()
    return f"{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.{suffix}"
