"""The content model's tables over the given ones. Each has the same definition in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gates import intake

AS_OF = "2024-01-31 00:00:00"
WINDOW_FROM = "2024-01-24 00:00:00"
TIERS = ("case", "core", "vertical", "depth", "signal")
MODULES = [(m, "functional" if m < 10 else "domain") for m in range(18)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let at most ``rows`` rows go to Python at a time in this session: whole texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.substring("source", 4, 9).cast("int")
    d = table(spark, sf_dir, "documents")
    gate = intake(F.col("text"), F.col("doc_id") % 60)
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("content"),
        F.col("source").alias("source_id"),
        (F.lit(0.5) + F.lit(0.05) * (n % 10)).alias("source_weight"),
        (F.col("doc_id") % 60).alias("age_days"),
        (F.col("doc_id") % 97).alias("topic_id"),
        F.when(n == 0, None).otherwise(F.element_at(F.array(*map(F.lit, TIERS)), n % 5 + 1)).alias("tier"),
        (F.col("doc_id") % 7 == 0).alias("tag_pending"),
        gate["status"].alias("gate_status"),
        gate["reason"].alias("gate_reason"),
        gate["measured"].alias("measured"),
    )


ARTICLES = """art AS (
  SELECT *, CASE WHEN age_days > 30 THEN 'excluded' WHEN chars < 200 THEN 'signal_only' ELSE 'included' END AS gate_status,
    CASE WHEN age_days > 30 THEN 'published_out_of_window' WHEN chars < 200 THEN 'title_only' ELSE '' END AS gate_reason,
    CAST(CASE WHEN age_days > 30 THEN age_days ELSE chars END AS DOUBLE) AS measured
  FROM (SELECT doc_id AS id, text AS content, source AS source_id, CAST(substr(source, 4) AS INTEGER) AS n,
      0.5 + 0.05 * (CAST(substr(source, 4) AS INTEGER) % 10) AS source_weight, doc_id % 60 AS age_days, doc_id % 97 AS topic_id,
      CASE CASE WHEN CAST(substr(source, 4) AS INTEGER) = 0 THEN 9 ELSE CAST(substr(source, 4) AS INTEGER) % 5 END
        WHEN 0 THEN 'case' WHEN 1 THEN 'core' WHEN 2 THEN 'vertical' WHEN 3 THEN 'depth' WHEN 4 THEN 'signal' END AS tier,
      doc_id % 7 = 0 AS tag_pending,
      CAST(length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) AS BIGINT) AS chars
    FROM documents) x)"""


def module_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long: id, module, score, for 18 modules of every document."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    m = d.withColumn("module", F.explode(F.sequence(F.lit(0), F.lit(17))))
    return m.withColumn("score", ((F.col("id") * 7 + F.col("module") * 13 + (F.col("id") * F.col("module")) % 11) % 101) / 10.0)


def score_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide: id and a map from module to score."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    entries = F.transform(F.sequence(F.lit(0), F.lit(17)), lambda m: F.struct(m.alias("key"), (((F.col("id") * 7 + m * 13 + (F.col("id") * m) % 11) % 101) / 10.0).alias("value")))
    return d.select("id", F.map_from_entries(entries).alias("scores"))


SCORES = """sc AS (SELECT doc_id AS id, CAST(m AS INTEGER) AS module, ((doc_id * 7 + m * 13 + (doc_id * m) % 11) % 101) / 10.0::DOUBLE AS score
  FROM documents, range(18) r(m))"""


def hot_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("topic_id"), F.col("event_id").alias("id"), F.col("event_type").alias("source_id"), (F.col("value") / 100).alias("source_weight"), F.col("ts").cast("timestamp").alias("published_at"))


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("cadence"), F.col("o_orderdate").cast("date").alias("issue_date"), F.col("o_custkey").alias("topic_id"), F.col("o_totalprice").alias("score"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The RELATED graph: part to supplier (numbers moved by a million)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1_000_000).alias("dst"), F.col("l_returnflag").alias("relation"), F.col("l_orderkey").alias("article_id"))


EDGES = "ed AS (SELECT l_partkey AS src, l_suppkey + 1000000 AS dst, l_returnflag AS relation, l_orderkey AS article_id FROM lineitem), pr AS (SELECT DISTINCT src AS a, dst AS b FROM ed), bo AS (SELECT a, b FROM pr UNION ALL SELECT b, a FROM pr), dg AS (SELECT a AS node, count(*) AS degree FROM bo GROUP BY a)"
