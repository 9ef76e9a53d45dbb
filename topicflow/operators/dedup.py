"""First, best, latest and top rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, keys: list, order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in ``order`` (which must leave no ties)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank_", rank).filter(F.col("rank_") <= n).drop("rank_")


def insert_if_new(pool: DataFrame, arrivals: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Arrivals whose key the pool lacks, the first of each key."""
    return top_n(arrivals, [key], order).join(pool.select(key).distinct(), key, "left_anti")


def one_per_key(df: DataFrame, key: str, *best: Column) -> DataFrame:
    """The row of each key with the greatest ``best``: an aggregate, so hot keys combine before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*best)).alias("row_")).select(key, "row_.*")


def backfilled(boards: DataFrame, pool: DataFrame, first: str, last: str, per_day: int, key: Column) -> DataFrame:
    """Rows to insert from the daily lists (day, id, score, ...) of a range: of each day the best ``per_day``, then each address once, on its first day, unless the ``pool`` (dedupe_key) has it.

    A list may be shown again on later days; days without one give nothing.
    """
    days = boards.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day_"))
    listed = boards.join(F.broadcast(days), F.col("day").cast("date") == F.col("day_")).drop("day_")  # a row a day of the range
    best = top_n(listed, ["day"], [F.desc("score"), F.asc("id")], per_day).withColumn("dedupe_key", key)
    return insert_if_new(pool, best, "dedupe_key", [F.asc("day"), F.desc("score"), F.asc("id")])
