"""Contiguous shards of near-equal bytes, by global prefix sums of per-partition totals.

DataFrame functions only. Rows are dealt to ranges of doc_id (without their texts); each
range's total and the prefix sum of the totals give every row its place in the whole, and the
line of bytes is cut at equal targets. A row goes where its middle byte lies.

Defined results: null text has no bytes; null doc_ids come first; repeated rows and ties of
doc_id are ordered by checksum and size and get slots of their own; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, text_or_empty


def shard_by_bytes(docs: DataFrame, shards: int = 24, row_bytes: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text_or_empty()) + F.lit(row_bytes)).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("nth"),
    )
    order = ["doc_id", "text_crc32", "size", "nth"]
    # the range of a row is fixed by writing it down: a second sampling could cut elsewhere
    dealt = materialize(rows.repartitionByRange(shuffle_partitions(spark), *order).withColumn("part", F.spark_partition_id()))

    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    whole = Window.partitionBy()
    prefix = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(whole).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        dealt.withColumn("own_bytes", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("own_rows", F.coalesce(F.count("*").over(inside), F.lit(0)))
        .join(F.broadcast(prefix), "part")  # bounded by the number of partitions
        .withColumn("at", F.col("bytes_before") + F.col("own_bytes"))
        .withColumn("row", F.col("rows_before") + F.col("own_rows"))
        .withColumn("shard", F.expr(f"cast(least({shards - 1}, ((2 * at + size) * {shards}) div (2 * all_bytes)) as int)"))
        .select("doc_id", "size", "text_crc32", "shard", "row")
    )
    first = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # a row per shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
