"""Appending tables: issues with their articles, snapshots, the log of model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import top_n
from ..operators.ranks import row_numbers
from ..operators.state import new_issues


def there(spark: SparkSession, path: str) -> bool:
    """Whether a folder exists, in any store that Spark knows."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def save_issue(issue: DataFrame, articles: DataFrame, folder: str) -> bool:
    """Append an issue (id, issue_date, cadence, ...) and its articles, their nested columns as JSON; False if that date and cadence has one."""
    spark = issue.sparkSession
    if there(spark, f"{folder}/issues") and new_issues(spark.read.parquet(f"{folder}/issues"), issue.select("issue_date", "cadence")).isEmpty():
        return False
    flat = [F.to_json(c).alias(f"{c}_json") if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in articles.dtypes]
    articles.select(*flat).write.mode("append").parquet(f"{folder}/generated")  # before the issue: a reader never sees an issue without them
    issue.write.mode("append").parquet(f"{folder}/issues")
    return True


def append_snapshot(board: DataFrame, source: str, taken: str, path: str) -> None:
    """One more snapshot of a source's board."""
    board.select(F.lit(source).alias("source"), F.lit(taken).alias("taken"), F.to_json(F.struct(*board.columns)).alias("row_json")).write.mode("append").parquet(path)


def recent_snapshots(spark: SparkSession, path: str, most: int = 2) -> DataFrame:
    """Rows of the latest snapshots of every source."""
    rows = spark.read.parquet(path)
    latest = top_n(rows.select("source", "taken").distinct(), ["source"], [F.desc("taken")], most)
    return rows.join(F.broadcast(latest), ["source", "taken"], "left_semi")  # a few rows a source


def append_log(calls: DataFrame, path: str) -> None:
    """Log rows (day, stage, at, ...) with numbers that go on where the day's and stage's stopped."""
    spark = calls.sparkSession
    new = row_numbers(calls, ["day", "stage"], ["at"], "number")
    if there(spark, path):
        most = spark.read.json(path).groupBy("day", "stage").agg(F.max("number").alias("most_"))
        new = new.join(most, ["day", "stage"], "left").withColumn("number", F.col("number") + F.coalesce("most_", F.lit(0))).drop("most_")
    new.write.mode("append").json(path)
