"""State changes as functions of the old table and a delta: each returns the new table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def upsert(old: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Columns of ``delta`` replace those of rows with its key; other rows stay, new keys are added."""
    fresh = [c for c in delta.columns if c != key]
    d = delta.select(key, *[F.col(c).alias(f"new_{c}") for c in fresh], F.lit(True).alias("hit_"))
    joined = old.join(d, key, "full_outer")
    return joined.select(key, *[F.when(F.col("hit_"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in old.columns if c != key])


def fill_nulls(old: DataFrame, values: DataFrame, key: str, col: str) -> DataFrame:
    """``col`` only where it is null, from a small table (key, value)."""
    return old.join(values.select(key, F.col(col).alias("fill_")), key, "left").withColumn(col, F.coalesce(col, "fill_")).drop("fill_")


def expire(old: DataFrame, pending: Column, before: Column, now: Column) -> DataFrame:
    """discarded_at of pending rows fetched before a moment."""
    return old.withColumn("discarded_at", F.when(F.col("discarded_at").isNull() & pending & (F.col("fetched_at") < before), now).otherwise(F.col("discarded_at")))


def merge_topics(topics: DataFrame, articles: DataFrame, losers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topics and articles after (loser, winner): articles move, seen spans join, merged scores reset."""
    moved = articles.join(losers.withColumnRenamed("loser", "topic_id"), "topic_id", "left").withColumn("topic_id", F.coalesce("winner", "topic_id")).drop("winner")
    to = topics.join(losers.withColumnRenamed("loser", "topic_id"), "topic_id", "left").withColumn("into", F.coalesce("winner", "topic_id"))
    own = F.col("topic_id") == F.col("into")
    merged = to.groupBy("into").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.when(F.count("*") == 1, F.max(F.when(own, F.col("score")))).alias("score"))
    return merged.withColumnRenamed("into", "topic_id"), moved


def attach_issue(ledger: DataFrame, issue_date: str, cadence: str, issue_id: int) -> DataFrame:
    """Ledger rows of that date and cadence without an issue get one."""
    hit = F.col("issue_id").isNull() & (F.col("issue_date") == issue_date) & (F.col("cadence") == cadence)
    return ledger.withColumn("issue_id", F.when(hit, F.lit(issue_id)).otherwise(F.col("issue_id")))


def mark_published(topics: DataFrame, published: DataFrame, cadence: str) -> DataFrame:
    """The cadence's issue column of the topics in ``published`` (topic_id, issue_id); the other column stays."""
    col = "published_issue_id" if cadence == "daily" else "weekly_issue_id"
    hit = published.groupBy("topic_id").agg(F.max("issue_id").alias("hit_"))
    return topics.join(hit, "topic_id", "left").withColumn(col, F.coalesce("hit_", col)).drop("hit_")


def save_release(old: DataFrame, checked: DataFrame, now: Column, vendor: Column) -> DataFrame:
    """Release columns of the checked rows (id, is_release, vendor, kind): descriptors only of releases."""
    yes = F.coalesce("is_release", F.lit(False))
    fresh = checked.select("id", yes.alias("is_release"), F.when(yes, vendor).alias("vendor"), F.when(yes, F.col("kind")).alias("kind"), now.alias("checked_at"))
    return upsert(old, fresh, "id")


def split_members(articles: DataFrame, evicted: DataFrame, new_topic: Column) -> tuple[DataFrame, DataFrame]:
    """Articles after the ``evicted`` (id) got topics of their own, and the topics whose scores are void."""
    out = articles.join(evicted.select("id", F.lit(True).alias("out_")), "id", "left")
    void = out.filter("out_").select("topic_id").distinct()
    return out.withColumn("topic_id", F.when(F.col("out_"), new_topic).otherwise(F.col("topic_id"))).drop("out_"), void


def new_issues(issues: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted (issue_date, cadence) that no issue has yet."""
    return wanted.join(issues.select("issue_date", "cadence").distinct(), ["issue_date", "cadence"], "left_anti")


def assign(articles: DataFrame, topics: DataFrame, given: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Articles and topics after (id, topic_id): members move, their topics were last seen ``now``; scores stay."""
    to = given.select("id", F.col("topic_id").alias("to_"))
    moved = articles.join(to, "id", "left").withColumn("topic_id", F.coalesce("to_", "topic_id")).drop("to_")
    seen = given.select("topic_id", F.lit(True).alias("seen_")).distinct()
    return moved, topics.join(seen, "topic_id", "left").withColumn("last_seen", F.when(F.col("seen_"), now).otherwise(F.col("last_seen"))).drop("seen_")


def repointed(table: DataFrame, losers: DataFrame, col: str = "topic_id") -> DataFrame:
    """Any table that names topics (ledger, generated articles, vectors) after (loser, winner)."""
    to = losers.select(F.col("loser").alias(col), "winner")
    return table.join(to, col, "left").withColumn(col, F.coalesce("winner", col)).drop("winner").select(*table.columns)


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """A table rebuilt from scratch in the old one's columns and types."""
    return new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in old.schema])


def evolved(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """``df`` with the columns (name: type) that a newer schema has and it lacks, as nulls."""
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in wanted.items() if c not in df.columns])


def in_order(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``ids`` (pos, key) in their order; unknown ids have none, no ids give no rows."""
    return ids.join(df, key).orderBy("pos")


def trimmed_sources(generated: DataFrame, kept: DataFrame) -> DataFrame:
    """Generated articles (id, topic_id, source_ids) whose source lists lose ids that left the topic, unless nothing would be left."""
    members = kept.groupBy("topic_id").agg(F.collect_set("id").alias("kept_"))
    left = F.filter("source_ids", lambda x: F.array_contains("kept_", x))
    return generated.join(members, "topic_id", "left").withColumn("source_ids", F.when(F.size(left) > 0, left).otherwise(F.col("source_ids"))).drop("kept_")


def anchors(members: DataFrame, generated: DataFrame, same: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(topic_id, anchor): the article that a topic of several is about.

    ``members`` (topic_id, id, title, content, published_at) are articles in use, ``generated`` (topic_id, id,
    title, content, created_at) written ones. ``same`` takes pairs (id, title, content, other, other_title, other_content)
    and gives (id, other, same), all pairs asked in one batch. The anchor is the first member, by published_at and
    id, that speaks of the event of the topic's newest written article, else the first member; no answer is no.
    """
    crowded = members.groupBy("topic_id").agg(F.count("*").alias("n_")).filter("n_ > 1").select("topic_id")
    own = members.filter("topic_id is not null").join(crowded, "topic_id")
    newest = generated.groupBy("topic_id").agg(F.max_by(F.struct(F.col("id").alias("other"), F.col("title").alias("other_title"), F.col("content").alias("other_content")), F.struct("created_at", "id")).alias("g_"))
    pairs = own.join(newest, "topic_id").select("id", "title", "content", "g_.*")
    yes = same(pairs).filter("same").select("id", F.lit(True).alias("yes_")).distinct()
    place = F.struct(F.col("yes_").isNull().alias("no"), "published_at", "id")
    return own.join(yes, "id", "left").groupBy("topic_id").agg(F.min_by("id", place).alias("anchor"))


@dataclass
class Repaired:
    """``articles``: id, topic_id; ``evicted``: id, topic_id (the new one), title; ``topics``: topic_id, representative_title of topics whose scores are void; ``generated``: with trimmed source_ids."""

    articles: DataFrame
    evicted: DataFrame
    topics: DataFrame
    generated: DataFrame


def repair_false_merges(members: DataFrame, generated: DataFrame, same: Callable[[DataFrame], DataFrame], new_topic: Column) -> Repaired:
    """Members that do not speak of their anchor's event get topics of their own (``new_topic``, of the member's row).

    A topic that lost members takes its anchor's title, and its scores are void; written articles lose sources that
    left their topic. A member about whom there is no answer stays.
    """
    chosen = cut(anchors(members, generated, same))
    told = members.select("id", F.col("title").alias("other_title"), F.col("content").alias("other_content"))
    of = chosen.join(told.withColumnRenamed("id", "anchor"), "anchor")
    pairs = members.join(of, "topic_id").filter("id <> anchor").select("id", "title", "content", F.col("anchor").alias("other"), "other_title", "other_content")
    out = cut(same(pairs).filter("not same").select("id").distinct())
    articles, void = split_members(members, out, new_topic)
    articles = cut(articles.select("id", "topic_id", "title"))
    topics = void.join(of, "topic_id").select("topic_id", F.col("other_title").alias("representative_title"))
    trimmed = trimmed_sources(generated.join(void, "topic_id", "left_semi"), articles)
    rest = generated.join(void, "topic_id", "left_anti")
    return Repaired(articles.select("id", "topic_id"), articles.join(out, "id", "left_semi"), topics, trimmed.select(*rest.columns).union(rest))
