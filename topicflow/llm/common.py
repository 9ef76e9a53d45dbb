"""Helpers shared by the corpus operators: reading, checkpoints, Arrow emission."""

from __future__ import annotations

import contextlib
import math
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; where unset, a local one in local mode (tests), else an error."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return conf or spark.conf.get("topicflow.test.checkpoint.dir", None) or _local_dir(spark)


def _local_dir(spark: SparkSession) -> str:
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="topicflow-ckpt-")
    spark.conf.set("topicflow.test.checkpoint.dir", path)
    return path


#: Folders of :func:`written` that are still there, in the order in which they were made.
_folders: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it back.

    A lost executor costs only the tasks it ran; the files go when the session's JVM ends.
    """
    return written(df)[0]


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """:func:`materialize`, and the folder, for :func:`removed`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/topicflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop, system = _folder(spark, path)
    system.deleteOnExit(hadoop)
    _folders.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of :func:`written` that nothing reads any more."""
    hadoop, system = _folder(spark, path)
    system.delete(hadoop, True)
    if path in _folders:
        _folders.remove(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables written inside go at the end, but for those whose folders are put into the list that it gives: the ones that something still reads."""
    kept, before = [], set(_folders)
    yield kept
    for path in [p for p in _folders if p not in before and p not in kept]:
        removed(spark, path)


def _folder(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let at most ``rows`` rows go to Python at a time in this session: whole texts may be long, and a batch is held twice by the JVM and once by Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000") or 10000)
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)


def _kept() -> dict:
    return sys.modules.setdefault("_topicflow_worker", types.ModuleType("_topicflow_worker")).__dict__.setdefault("kept", {})


def per_worker(key: tuple, make):
    """``make()``, once per Python worker: caches outlive a task and warm the next one's, until :func:`slices` serves a task without this key."""
    kept = _kept()
    if key not in kept:
        kept[key] = make()
    return kept[key]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500, key: tuple | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``rows`` at most, so that few texts are Python objects at a time.

    Of what the worker keeps only ``key`` stays: workers outlive an operator, and another one needs their memory.
    """
    kept = _kept()
    for k in [k for k in kept if k != key]:
        del kept[k]
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, exactly: int64, or Python's integers where those are too short."""
    if float(np.abs(values).max(initial=0)) * scale < 2.0**62:
        return np.floor(values * scale).astype(np.int64)
    flat = [int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in values.ravel().tolist()]
    out = np.empty(len(flat), object)
    out[:] = flat
    return out.reshape(values.shape)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """A record batch from lists or arrays in the schema's order."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


__all__ = ["table", "text_or_empty", "shared_dir", "materialize", "written", "removed", "scratch", "text_batches", "per_worker", "slices", "integers", "shuffle_partitions", "batch"]
