"""Row numbers and ranks without a window over a whole table or a hot key.

Rows are dealt to ranges of the order and numbered inside a range; what a range's rows have
before them is the sum of the smaller ranges' counts. A key with a third of all rows is spread
over a third of the ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def row_numbers(df: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    """``df`` with the row's number (from 1) among the rows of its ``by`` in ascending ``order``, which must leave no ties."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written down: a second sampling of the ranges could cut elsewhere
    dealt = cut(df.repartitionByRange(parts, *by, *order).withColumn("part_", F.spark_partition_id()))
    counts = dealt.groupBy("part_", *by).agg(F.count("*").alias("n_"))
    ahead = Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = counts.select(F.col("part_").alias("p_"), *[F.col(c).alias(f"{c}_") for c in by], F.coalesce(F.sum("n_").over(ahead), F.lit(0)).alias("before_"))
    own = F.row_number().over(Window.partitionBy("part_", *by).orderBy(*order))
    same = F.col("part_") == F.col("p_")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    numbered = dealt.withColumn("own_", own).join(before, same)
    return numbered.select(*df.columns, (F.col("own_") + F.col("before_")).alias(out))


def dense_ranks(df: DataFrame, col: str, out: str) -> DataFrame:
    """(col, out): the dense rank of every distinct value."""
    return row_numbers(df.select(col).distinct(), [], [col], out)


def average_ranks(df: DataFrame, by: list[str], col: str, out: str) -> DataFrame:
    """(by, col, out, n): rank of every distinct value, ties at their mean place, and how many rows have it."""
    values = df.groupBy(*by, col).agg(F.count("*").alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(values.repartitionByRange(parts, *by, col).withColumn("part_", F.spark_partition_id()))
    ahead = Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("part_", *by).agg(F.sum("n").alias("n_")).select(F.col("part_").alias("p_"), *[F.col(c).alias(f"{c}_") for c in by], F.coalesce(F.sum("n_").over(ahead), F.lit(0)).alias("before_"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("part_", *by).orderBy(col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = F.col("part_") == F.col("p_")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    return dealt.withColumn("own_", own).join(before, same).select(*by, col, (F.col("own_") + F.col("before_") + (F.col("n") + 1) / 2).alias(out), "n")
