"""Heat, ranks and module scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import days_between, half_life
from .gates import is_quota_reason
from .lineage import cut
from .ranks import dense_ranks


def hotness(articles: DataFrame, as_of: Column, life: float = 3.5, by: str = "topic_id") -> DataFrame:
    """Distinct sources x mean weight x decay of the newest row's age."""
    age = days_between(as_of, F.max("published_at"))
    return articles.groupBy(by).agg((F.count_distinct("source_id") * F.avg("source_weight") * half_life(age, life)).alias("hotness"))


def map_total(scores: Column) -> Column:
    return F.aggregate(F.map_values(scores), F.lit(0.0), lambda a, x: a + x)


def top_entry(scores: Column) -> Column:
    """struct(score, neg_pos, key) of the greatest value; the first of equals."""
    entries = F.transform(F.map_entries(scores), lambda e, i: F.struct(e["value"].alias("score"), (-i).alias("neg_pos"), e["key"].alias("key")))
    return F.array_max(entries)


def mode_by_first(df: DataFrame, key: str, value: Column, order: list[str]) -> DataFrame:
    """The most frequent value of each key; of equals the one seen first in ascending ``order``. Aggregates only, so hot keys combine before the shuffle."""
    each = df.groupBy(key, value.alias("value")).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    best = each.groupBy(key).agg(F.max("n").alias("n"))
    return each.join(best, [key, "n"]).groupBy(key).agg(F.min_by("value", "first").alias("value"))


def dense_share(df: DataFrame, col: str, out: str) -> DataFrame:
    """(dense rank - 1) / (distinct values - 1), 0 for one value; ranks come from ranges of the distinct values."""
    ranked = dense_ranks(df, col, "d_")
    top = ranked.agg(F.max("d_").alias("m_"))
    share = F.when(F.col("m_") == 1, 0.0).otherwise((F.col("d_") - 1) / (F.col("m_") - 1))
    return df.join(ranked.join(F.broadcast(top)).select(col, share.alias(out)), col)


def entity_heat(entities: DataFrame, window: Column) -> DataFrame:
    """(topic_id, heat): other topics' articles in the window that share an entity with the topic.

    ``entities`` has topic_id, article_id, entity; keys compare stripped and lower-cased, and a topic's
    own come from all its articles. Articles in the window with the same set of entities count together. A set of one
    entity is a number that is added to the topics which have it: a row for each topic and entity, whatever the number of
    articles. Sets of several are dealt to tiles of topics and sets, where a topic marks the sets that it meets, so that
    no row is made for a pair of topic and article, and no task holds more than a tile.
    """
    keyed = entities.withColumn("key_", F.lower(F.trim("entity"))).filter(F.col("key_") != "")
    own = keyed.select("topic_id", "key_").distinct()
    seen = keyed.filter(window).groupBy("topic_id", "article_id").agg(F.array_sort(F.collect_set("key_")).alias("keys"))
    sets = cut(seen.groupBy("topic_id", "keys").agg(F.count("*").alias("n")))
    weights = sets.groupBy("keys").agg(F.sum("n").alias("n"))
    single = weights.filter(F.size("keys") == 1).select(F.col("keys")[0].alias("key_"), "n")
    met = own.join(single, "key_").select("topic_id", "n")
    several = weights.filter(F.size("keys") > 1)
    mine = sets.select("topic_id", (-F.col("n")).alias("n"))  # a topic shares an entity with each of its own articles
    met = met.union(mine).union(_met_sets(own, several))
    heat = met.groupBy("topic_id").agg(F.sum("n").alias("heat"))
    return own.select("topic_id").distinct().join(heat.withColumnRenamed("topic_id", "t_"), F.col("topic_id").eqNullSafe(F.col("t_")), "left").select("topic_id", F.coalesce("heat", F.lit(0)).alias("heat"))


def _met_sets(own: DataFrame, sets: DataFrame, most_topics: int = 4096, most_sets: int = 16384) -> DataFrame:
    """(topic_id, n): the summed ``n`` of the sets (keys, n) that share a key with the topic's own (topic_id, key_)."""
    kind = dict(own.dtypes)["topic_id"]
    wanted = sets.select(F.explode("keys").alias("key_")).distinct()
    topics = cut(own.join(wanted, "key_", "left_semi").groupBy("topic_id").agg(F.collect_list("key_").alias("keys")))
    sets = cut(sets)
    rows, columns = (max(1, -(-df.count() // most)) for df, most in ((topics, most_topics), (sets, most_sets)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = topics.withColumn("row_", F.pmod(F.xxhash64("topic_id"), F.lit(rows))).withColumn("column_", every(columns))
    right = sets.withColumn("column_", F.pmod(F.xxhash64("keys"), F.lit(columns))).withColumn("row_", every(rows))

    def met(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        place: dict[str, int] = {}
        at = [[place.setdefault(k, len(place)) for k in keys] for keys in theirs["keys"]]
        own_at = [[place[k] for k in keys if k in place] for keys in ours["keys"]]
        out = np.zeros(len(ours), np.int64)
        n, holders = theirs["n"].to_numpy(), [[] for _ in place]
        for s, keys in enumerate(at):
            for k in keys:
                holders[k].append(s)
        holders = [np.array(h) for h in holders]
        hit = np.zeros(len(theirs), bool)
        for t, keys in enumerate(own_at):
            hit[:] = False
            for k in keys:
                hit[holders[k]] = True
            out[t] = n[hit].sum()
        return pd.DataFrame({"topic_id": ours["topic_id"], "n": out})

    tiles = ["row_", "column_"]
    return left.groupBy(*tiles).cogroup(right.groupBy(*tiles)).applyInPandas(met, f"topic_id {kind}, n long")


def trend(counts: Column, base: Column, recent_days: int = 14, base_days: int = 60, smoothing: float = 0.01) -> Column:
    """Recent count x recent rate over base rate."""
    return counts * (counts / recent_days) / (base / base_days + smoothing)


def qualified_days(trace: DataFrame, cadence: str, first: str, last: str) -> DataFrame:
    """(topic_id, days): on how many issue dates of a range a topic was chosen, or refused only for want of a place.

    ``trace`` is the selection ledger (topic_id, decision, reason, issue_date, cadence).
    """
    fit = (F.col("decision") == "selected") | is_quota_reason(F.col("reason"))
    inside = trace.filter((F.col("cadence") == cadence) & F.col("issue_date").between(first, last) & F.coalesce(fit, F.lit(False)))
    return inside.groupBy("topic_id").agg(F.count_distinct("issue_date").alias("days"))
