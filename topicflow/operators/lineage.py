"""Cutting lineage in loops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; where none is set, a local one in local mode (tests), else an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None and context.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="topicflow-")


_own: set[str] = set()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that plans in loops stay short; the session's folder goes when its JVM ends.

    A table, not a checkpoint: a checkpoint keeps the size that Spark guessed for the plan it was made by, and in a loop of joins
    the guess is a product of guesses whose digits triple every round, until planning does not end.
    """
    return written(df)[0]


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """:func:`cut`, and the table's folder, for :func:`removed`."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    folder = context.getCheckpointDir()  # Spark gives every session one of its own below the shared one
    if folder not in _own:
        _own.add(folder)
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    table = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(table)
    return df.sparkSession.read.schema(df.schema).parquet(table), table


def removed(spark: SparkSession, table: str) -> None:
    """Delete a table of :func:`written` that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
