"""Choosing topics for an issue, with a ledger of every decision.

Scores, ranks and the ledger are DataFrames of any size. The rotation under shared quotas is
sequential by nature: it runs per issue key in ``applyInPandas`` on candidates first pruned to
the best ``total_max`` of each (module, type, tier, dominant group) cell, which the quotas cannot
look beyond: rows of a cell fit or fail together.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedup import top_n
from .lineage import cut
from .ranks import row_numbers


def all_qualified(candidates: DataFrame, min_score: float = 6.0) -> DataFrame:
    """decision and reason for every candidate (top_score)."""
    ok = F.col("top_score") >= min_score
    return candidates.withColumn("decision", F.when(ok, "selected").otherwise("rejected")).withColumn("reason", F.when(ok, "all_qualified").otherwise("below_module_threshold"))


def displayed(selected: DataFrame, total: str = "total", hotness: str = "hotness") -> DataFrame:
    """Selected topics with their place: by total, then hotness, then id."""
    ordered = selected.select("*", (-F.col(total)).alias("neg_total_"), (-F.col(hotness)).alias("neg_hot_"))
    return row_numbers(ordered, [], ["neg_total_", "neg_hot_", "id"], "place").drop("neg_total_", "neg_hot_")


def area_quota(candidates: DataFrame, quotas: dict[str, int], total_min: int, total_max: int, boost: float = 0.3) -> DataFrame:
    """Best of each area up to its quota, filled up to ``total_min``, cut at ``total_max``.

    Areas are cut to their best rows before the shuffle; what is ordered as a whole is ``total_min`` rows of the rest.
    """
    final = F.col("base_score") * (1 + boost * F.tanh(F.col("tag_boost") / 10))
    quota = F.coalesce(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])[F.col("area")], F.lit(0))
    most = max([total_min, *quotas.values()])
    in_area = F.row_number().over(Window.partitionBy("area").orderBy(F.desc("final_score"), "id"))
    best = candidates.withColumn("final_score", final).withColumn("in_area", in_area).filter(F.col("in_area") <= most)
    chosen = best.filter(F.col("in_area") <= quota).select("id", "area", "final_score")  # the quotas' sum at most
    rest = best.filter(F.col("in_area") > quota).orderBy(F.desc("final_score"), "id").limit(total_min)
    placed = rest.withColumn("place", F.row_number().over(Window.orderBy(F.desc("final_score"), "id")))  # of total_min rows
    filled = placed.join(chosen.agg(F.count("*").alias("have"))).filter(F.col("place") + F.col("have") <= total_min)
    kept = chosen.union(filled.select("id", "area", "final_score"))
    return kept.orderBy(F.desc("final_score"), "id").limit(total_max).select("id", "area", "final_score")


def attribution(top_score: Column, type_full: Column, group_full: Column, tier_full: Column, min_score: float = 6.0) -> Column:
    """Why a candidate was left out, from the final counters."""
    return F.when(top_score < min_score, "below_module_threshold").when(type_full, "content_type_quota_full").when(group_full, "module_group_quota_full").when(tier_full, "tier_quota_full").otherwise("slots_full")


def pruned(scores: DataFrame, total_max: int) -> DataFrame:
    """Candidates among the best ``total_max`` of a cell, by a module's score or by ``rank`` where given.

    ``scores`` is long: key, id, module, score, content_type, tier[, grp][, rank].
    """
    cell = [c for c in ("key", "module", "content_type", "tier", "grp") if c in scores.columns]
    best = [F.desc("score"), *([F.desc("rank")] if "rank" in scores.columns else []), F.asc("id")]
    return top_n(scores, cell, best, total_max).select("key", "id").distinct()


def rotation_order(modules: list[tuple], groups: tuple[str, ...] = ("domain", "functional")) -> list[tuple]:
    """(name, group) by group, in configured order within one."""
    return [m for g in groups for m in modules if m[1] == g]


def rotate(scores: DataFrame, modules: list[tuple[str, str]], total_max: int = 10, per_module: int = 1, min_score: float = 6.0, types: dict[str, int] | None = None, tiers: dict[str, int] | None = None, groups: dict[str, int] | None = None, total_min: int = 0, order: list[str] | None = None) -> DataFrame:
    """(key, place, id, via): module rotation, then a fill by rank, under all caps.

    The rotation skips on content type and tier and ends a module where its own group is full; a
    pick counts for the group of its own best module, whichever module picked it, and the fill
    looks at that group. Up to ``total_min`` a floor round goes on without caps, and a last one
    without the least score.

    ``scores`` is long: key, id, module, score, content_type, tier[, rank]. ``modules`` are (name,
    group) in rotation order, domain before functional (``rotation_order``). ``rank`` (weekly
    potential; without it the total of all modules) breaks a module's ties and orders the fill and
    the result. ``order`` is the modules' own order, in which a topic's best is the first of equals.
    """
    types, tiers, groups = types or {}, tiers or {}, groups or {}
    names = [m for m, _ in modules]
    group_of = dict(modules)
    own_order = (order or names).index

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="id", columns="module", values="score", aggfunc="max").reindex(columns=names).fillna(0.0)
        info = pdf.drop_duplicates("id").set_index("id").sort_index()
        wide = wide.loc[info.index]
        best = wide[sorted(names, key=own_order)].idxmax(axis=1)  # of equal modules the first of the configuration
        total = info["rank"] if "rank" in info else wide.sum(axis=1).round(9)
        picked: dict = {}
        used: dict = {"type": {}, "tier": {}, "group": {}}

        def fits(i, group: bool = True) -> bool:
            caps = (("type", info.content_type[i], types), ("tier", info.tier[i], tiers), *([("group", group_of[best[i]], groups)] if group else []))
            return all(used[k].get(v, 0) < cap.get(v, 10**9) for k, v, cap in caps)

        def take(i, via: str) -> None:
            picked[i] = via
            for k, v in (("type", info.content_type[i]), ("tier", info.tier[i]), ("group", group_of[best[i]])):
                used[k][v] = used[k].get(v, 0) + 1

        for m in names:
            n = 0
            for i in sorted(wide.index, key=lambda i: (-wide[m][i], -total[i], i) if "rank" in info else (-wide[m][i], i)):
                full = used["group"].get(group_of[m], 0) >= groups.get(group_of[m], 10**9)
                if n >= per_module or len(picked) >= total_max or full or wide[m][i] < min_score:
                    break
                if i not in picked and fits(i, group=False):
                    take(i, "rotation")
                    n += 1
        by_rank = sorted(wide.index, key=lambda i: (-total[i], i))
        for i in by_rank:
            if len(picked) >= total_max:
                break
            if i not in picked and wide.loc[i].max() >= min_score and fits(i):
                take(i, "fill")
        for via, least in (("floor", min_score), ("below_threshold", float("-inf"))):
            for i in by_rank:
                if len(picked) >= min(total_min, total_max):
                    break
                if i not in picked and wide.loc[i].max() >= least:
                    take(i, via)
        rows = sorted(picked, key=lambda i: (-total[i], i))
        return pd.DataFrame({"key": pdf["key"].iloc[0], "place": range(1, len(rows) + 1), "id": rows, "via": [picked[i] for i in rows]})

    return scores.groupBy("key").applyInPandas(greedy, "key string, place long, id long, via string")


def ledger(candidates: DataFrame, picks: DataFrame, min_score: float = 6.0, types: dict[str, int] | None = None, tiers: dict[str, int] | None = None, groups: dict[str, int] | None = None) -> DataFrame:
    """(key, id, decision, reason) for every candidate (key, id, content_type, tier, grp, top_score).

    Selected ones carry the round that took them; the others are judged by the final counters.
    """
    chosen = picks.select("key", "id", "via")
    marked = candidates.join(chosen, ["key", "id"], "left")
    out = marked
    for col, caps in (("content_type", types), ("tier", tiers), ("grp", groups)):
        used = marked.filter("via is not null").groupBy("key", col).agg(F.count("*").alias("n_"))  # a row per key and value at most
        cap = F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col(col)) if caps else F.lit(None).cast("int")
        out = out.join(used, ["key", col], "left").withColumn(f"{col}_full", F.coalesce(F.coalesce("n_", F.lit(0)) >= cap, F.lit(False))).drop("n_")
    why = attribution(F.col("top_score"), F.col("content_type_full"), F.col("grp_full"), F.col("tier_full"), min_score)
    return out.select("key", "id", F.when(F.col("via").isNull(), "rejected").otherwise("selected").alias("decision"), F.coalesce("via", why).alias("reason"))


def outcome(n_sources: Column, error: Column, coherent: Column, confidence: Column, tries: Column, again: float = 0.6, review: float = 0.8, most: int = 2) -> Column:
    """What becomes of a generated article: a refusal, another try, a review or publication."""
    return (
        F.when(n_sources == 0, "insufficient_sources").when(error.isNotNull(), "generation_error").when(coherent.eqNullSafe(F.lit(False)), "failed_selfcheck")
        .when((confidence < again) & (tries < most), "regenerate").when(confidence < review, "needs_review").otherwise("ready")
    )


def split_reusable(selected: DataFrame, generated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Selected topics that have an article already (the newest is reused), and those to be written."""
    newest = generated.groupBy("topic_id").agg(F.max_by(F.struct(F.col("id").alias("article_id"), F.col("issue_id").alias("reused_from_issue")), F.struct("created_at", "id")).alias("g_"))
    return selected.join(newest, "topic_id").select(*selected.columns, "g_.*"), selected.join(newest, "topic_id", "left_anti")


def filled_up(select, write, total_min: int, rounds: int = 3) -> DataFrame:
    """(topic_id, place): what could be written, in first-seen order, after further rounds for what failed.

    ``select(tried)`` gives (topic_id, place) without the topics ``tried`` (None at first); ``write``
    gives the topic_ids that succeed. Later rounds take only what is missing; an issue is a few rows.
    """
    done = tried = None
    for n in range(rounds):
        have = 0 if done is None else done.count()
        if have >= total_min:
            break
        chosen = select(tried)
        if n:
            chosen = chosen.orderBy("place").limit(total_min - have)
        chosen = cut(chosen.select("topic_id", (F.col("place") + F.lit(n * 1_000_000)).alias("place")))
        if chosen.isEmpty():
            break
        tried = chosen.select("topic_id") if tried is None else tried.union(chosen.select("topic_id"))
        new = chosen.join(write(chosen), "topic_id", "left_semi")
        done = cut(new if done is None else done.union(new))
    return row_numbers(done.withColumnRenamed("place", "seen_"), [], ["seen_"], "place").drop("seen_")


def writing_sources(articles: DataFrame, most: int = 5) -> DataFrame:
    """(topic_id, id, relevance): a topic's own substantive articles, the most relevant ``most`` if there are more."""
    own = articles.filter(F.coalesce("gate_status", F.lit("included")) == "included")
    return top_n(own.select("topic_id", "id", "relevance"), ["topic_id"], [F.desc("relevance"), F.asc("id")], most)


def digest_prompts(items: DataFrame, group: list[str], per_group: int = 3) -> DataFrame:
    """(key, prompt) for a summary of each group's best items (url, title, score, ...), repeated addresses once."""
    once = items.groupBy("url").agg(F.max_by(F.struct(*items.columns), F.struct("score", "title")).alias("r")).select("r.*")
    best = top_n(once, group, [F.desc("score"), F.asc("url")], per_group)
    lines = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "url", "title")))
    told = F.transform(lines, lambda x: F.concat(F.lit("- "), x["title"], F.lit(" "), x["url"]))
    return best.groupBy(*group).agg(F.array_join(told, "\n").alias("prompt")).select(F.concat_ws("/", *group).alias("key"), "prompt")
