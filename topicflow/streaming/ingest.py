"""The ingest increment as a stream, and counts that a stream keeps with bounded state.

Aggregates work in update mode under a watermark: a batch's changed rows are appended to a table of changes, the last
change of a key counts, and the state holds open windows only. Rows later than the watermark are dropped from aggregates;
the ingest itself drops nothing for its age, it marks it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import dedupe_key
from ..operators.gates import intake
from ..sources.sinks import there


def bucket(key, buckets: int):
    """The part of the pool that a key is in."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def pool_writer(pool: str, as_of: str, buckets: int = 64):
    """For foreachBatch: rows whose key the pool lacks, gated (late rows are marked, not dropped).

    The pool is partitioned by a hash of the key, so a batch reads the keys of the parts it has rows for, and no other column.
    """

    def write(arrivals: DataFrame, batch_id: int) -> None:
        spark = arrivals.sparkSession
        age = F.date_diff(F.lit(as_of).cast("date"), F.col("published_at").cast("date"))
        keyed = arrivals.withColumn("dedupe_key", dedupe_key(F.col("url"))).withColumn("gate", intake(F.col("content"), age)).withColumn("batch_id", F.lit(batch_id)).withColumn("bucket", bucket("dedupe_key", buckets))
        first = keyed.groupBy("dedupe_key").agg(F.min_by(F.struct("*"), F.struct("published_at", "url")).alias("r")).select("r.*")
        if there(spark, pool):
            touched = [r["bucket"] for r in keyed.select("bucket").distinct().collect()]  # at most ``buckets``
            # a batch that runs again replaces what it wrote
            known = spark.read.parquet(pool).filter(F.col("bucket").isin(touched) & (F.col("batch_id") != batch_id)).select("dedupe_key")
            first = first.join(known, "dedupe_key", "left_anti")
        first.write.partitionBy("bucket", "batch_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(pool)

    return write


def pooled(spark: SparkSession, pool: str, arrivals: DataFrame) -> DataFrame:
    """The pool's rows; none, with the columns that ``arrivals`` would have there, where nothing came yet."""
    if there(spark, pool):
        return spark.read.parquet(pool)
    return spark.createDataFrame([], arrivals.schema.add("dedupe_key", "string").add("bucket", "int").add("batch_id", "int"))


def once(arrivals: DataFrame, within: str = "30 days") -> DataFrame:
    """Arrivals whose key did not arrive ``within`` that time before; by the time of arrival (arrived_at), so age drops nothing, and keys leave the state when it is over."""
    keyed = arrivals.withColumn("once_key", dedupe_key(F.col("url"))).withWatermark("arrived_at", within)
    return keyed.dropDuplicatesWithinWatermark(["once_key"]).drop("once_key")


def start(arrivals: DataFrame, pool: str, checkpoint: str, as_of: str, within: str | None = None) -> StreamingQuery:
    """Into the pool; with ``within`` repeated keys are taken out before a batch asks the pool (arrivals then have arrived_at)."""
    rows = arrivals if within is None else once(arrivals, within)
    return rows.writeStream.foreachBatch(pool_writer(pool, as_of)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 day", width: str = "7 days", step: str = "1 day") -> DataFrame:
    """Events per type and sliding window, late rows up to ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def daily_counts(events: DataFrame, tag: str, ts: str = "ts", late: str = "3 days") -> DataFrame:
    """(window, tag, n): a row per tag and day, so that rates of any length are sums of few rows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), tag).agg(F.count("*").alias("n"))


def recent_and_base(days: DataFrame, as_of: str, recent: int = 14, base: int = 60) -> DataFrame:
    """(tag, recent, base): counts of the days before ``as_of``."""
    tag = [c for c in days.columns if c not in ("day", "n")]
    end = F.lit(as_of).cast("date")
    within = days.filter((F.col("day") >= F.date_sub(end, base)) & (F.col("day") < end))
    return within.groupBy(*tag).agg(F.sum(F.when(F.col("day") >= F.date_sub(end, recent), F.col("n")).otherwise(0)).alias("recent"), F.sum("n").alias("base"))


def hourly_latest(events: DataFrame, source: str, row: str, ts: str = "ts", late: str = "6 hours") -> DataFrame:
    """(window, source, row): the latest row of each source and hour."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), source).agg(F.max_by(row, F.struct(ts, row)).alias(row))


def change_writer(out: str):
    """For foreachBatch: rows under their batch's number; a batch that runs again replaces what it wrote."""

    def write(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch)).write.partitionBy("batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(out)

    return write


def keep_changes(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the rows of an aggregate that a batch changed."""
    return rows.writeStream.outputMode("update").foreachBatch(change_writer(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_changes(spark: SparkSession, out: str, key: list[str], like: DataFrame) -> DataFrame:
    """The last row of each key in a table of :func:`keep_changes` whose rows are ``like``; none where nothing came yet."""
    rows = spark.read.parquet(out) if there(spark, out) else spark.createDataFrame([], like.schema.add("batch", "int"))
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in like.columns if c not in key]), "batch").alias("r_")).select(*key, "r_.*")
