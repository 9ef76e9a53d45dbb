"""Topics given to vectors as they arrive: a stateful operator, keyed by bucket.

A bucket (a list of the vector index, a module, a language) keeps the vectors it has seen with their topics in the state
store, so that a batch costs its own rows against those of their buckets and nothing else. State
outlives batches and restarts from the checkpoint. Rows of one bucket meet in one task, in order of
their ids; a bucket's size is bounded by ``keep_ms`` (time to live of a vector in the state), so choose buckets
like the index's lists, which grow in number and not in size.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources.sinks import there
from .ingest import change_writer

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: One row a change of an id's topic; ``step`` is the arrival that caused it.
CHANGES = "bucket string, id long, topic long, step long"


@contextmanager
def on_disk_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's setting is put back."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Assigner(StatefulProcessor):
    """Arrivals join the topic of their best earlier neighbour at ``threshold``; other topics among their ``most`` best merge into it."""

    def __init__(self, threshold: float, most: int, keep_ms: int | None):
        self.threshold, self.most, self.keep_ms = threshold, most, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "id long", "vector array<double>, topic long", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  the interface's names
        state = {k[0]: v for k, v in self.seen.iterator()} if self.seen.exists() else {}
        arrivals = pd.concat(list(rows)).drop_duplicates("id").sort_values("id")
        arrivals = arrivals[~arrivals["id"].isin(list(state))]
        old = len(state)
        ids = np.array([*state, *arrivals["id"]], np.int64)
        topics = np.array([*(v[1] for v in state.values()), *arrivals["id"]], np.int64)
        vectors = np.array([*(v[0] for v in state.values()), *arrivals["vector"].tolist()], np.float64)
        changes: dict[int, tuple[int, int]] = {}
        for n in range(old, len(ids)):
            score = np.round(vectors[:n] @ vectors[n], 9)
            near = np.flatnonzero((score >= self.threshold) & (ids[:n] < ids[n]))
            near = near[np.lexsort((ids[near], -score[near]))[: self.most]]
            touched = np.array([n])
            if len(near):
                into = topics[near[0]]
                merged = np.flatnonzero(np.isin(topics[:n], topics[near]) & (topics[:n] != into))
                topics[merged], topics[n] = into, into
                touched = np.append(merged, n)
            changes |= {int(k): (int(topics[k]), int(ids[n])) for k in touched}
        for k, (topic, _) in changes.items():
            self.seen.updateValue((int(ids[k]),), (vectors[k].tolist(), topic))
        yield pd.DataFrame([(str(key[0]), int(ids[k]), topic, step) for k, (topic, step) in changes.items()], columns=["bucket", "id", "topic", "step"])

    def close(self) -> None:
        pass


def changes(arrivals: DataFrame, threshold: float, most: int = 5, keep_ms: int | None = None) -> DataFrame:
    """The changes (bucket, id, topic, step) that a stream of (bucket, id, vector) makes; null ids and vectors are passed over, an id seen before is not assigned again."""
    clean = arrivals.filter("bucket is not null and id is not null and vector is not null")
    clean = clean.select(F.col("bucket").cast("string").alias("bucket"), F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    mode = "None" if keep_ms is None else "ProcessingTime"
    return clean.groupBy("bucket").transformWithStateInPandas(Assigner(threshold, most, keep_ms), CHANGES, "Append", mode)


def start(arrivals: DataFrame, out: str, checkpoint: str, threshold: float, most: int = 5, keep_ms: int | None = None) -> StreamingQuery:
    """Append the changes to the table at ``out``; a batch that runs again replaces what it wrote."""
    with on_disk_state(arrivals.sparkSession):
        return changes(arrivals, threshold, most, keep_ms).writeStream.foreachBatch(change_writer(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def topics(spark: SparkSession, out: str) -> DataFrame:
    """(id, topic): the last change of each id."""
    rows = spark.read.parquet(out) if there(spark, out) else spark.createDataFrame([], CHANGES + ", batch int")
    return rows.groupBy("id").agg(F.max_by("topic", F.struct("batch", "step")).alias("topic"))
