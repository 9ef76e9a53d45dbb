"""Order-dependent greedy clustering, as joins and rounds over all rows at once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedup import top_n
from .graph import components
from .lineage import cut


def _first_topics(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, tree): the id that began the topic which ``id`` joins by its best link, by pointer jumping."""
    best = links.groupBy("id").agg(F.max_by("near", F.struct("score", -F.col("near"))).alias("up"))
    at = cut(ids.select("id").distinct().join(best, "id", "left").select("id", F.coalesce("up", "id").alias("tree")))
    while True:
        above = at.select(F.col("id").alias("tree"), F.col("tree").alias("next"))
        new = cut(at.join(above, "tree", "left").select("id", F.col("tree").alias("old"), F.coalesce("next", "tree").alias("tree")))
        at = new.select("id", "tree")
        if new.filter("old != tree").isEmpty():
            return at


def match_rule(status: Column, near_status: Column, score: Column, said: Column | None, same: float = 0.72, low: float = 0.65, high: float = 0.85, title_only: float = 0.80) -> Column:
    """Whether two articles of these gate statuses speak of one event at ``score``; ``said`` is an oracle's answer, None without one.

    Only the four limits matter: a score between two of them decides as the lower one does.
    """
    plain = lambda c: F.coalesce(c, F.lit("included")) == "included"
    loose = score >= title_only if said is None else (score >= high) | ((score >= low) & F.coalesce(said, F.lit(False)))
    return F.when(plain(status) & plain(near_status), score >= same).otherwise(loose)


def matched(candidates: DataFrame, status: DataFrame, answers: DataFrame | None = None, same: float = 0.72, low: float = 0.65, high: float = 0.85, title_only: float = 0.80) -> DataFrame:
    """The candidate pairs (id, near, score) that speak of one event.

    Two substantive articles match at ``same``. Where one is a title only, ``high`` matches, from
    ``low`` on the ``answers`` (id, near, same) of an oracle decide, no answer being no; without an
    oracle ``title_only`` is the limit. ``status`` is (id, gate_status).
    """
    near = status.select(F.col("id").alias("near"), F.col("gate_status").alias("near_status"))
    both = candidates.join(status.select("id", "gate_status"), "id").join(near, "near")
    if answers is not None:
        both = both.join(answers.select("id", "near", F.col("same").alias("said")), ["id", "near"], "left")
    fit = match_rule(F.col("gate_status"), F.col("near_status"), F.col("score"), None if answers is None else F.col("said"), same, low, high, title_only)
    return both.filter(fit & ~F.isnan("score")).select("id", "near", "score")


def statistics(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row (processed, new_topics, merged, topics_merged) from each id's first topic and its last one (id, topic)."""
    first = before.agg(F.count("*").alias("processed"), F.count_if(F.col("id") == F.col("topic")).alias("new_topics"))
    last = after.agg(F.count_distinct("topic").alias("left_"))
    return first.join(last).select("processed", "new_topics", (F.col("processed") - F.col("new_topics")).alias("merged"), (F.col("new_topics") - F.col("left_")).alias("topics_merged"))


def first_topics(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, topic): the topic that each id joined when it came, before any merge."""
    return _first_topics(ids, links).withColumnRenamed("tree", "topic")


def incremental(ids: DataFrame, candidates: DataFrame, threshold: float, published: DataFrame | None = None, first: DataFrame | None = None) -> DataFrame:
    """(id, topic): ids in order join the topic of their best earlier neighbour at ``threshold``, bridging topics merge.

    ``candidates`` (id, near, score) holds each id's best earlier neighbours (``matched`` decides
    which count). Topics in ``published`` (topic) take members but never merge, in either direction.
    ``first`` is :func:`first_topics` of the same links where that is known. Best links alone make
    trees, one for each topic ever begun. Other links that leave a tree merge topics into the one of
    the best link; only the first merge of two trees counts. So what has to be done in order are the
    merges between trees, and only within a component of them: members never meet in one task.
    """
    links = cut(candidates.filter((F.col("score") >= threshold) & ~F.isnan("score")).select("id", "near", "score"))
    tree = _first_topics(ids, links) if first is None else first.withColumnRenamed("topic", "tree")
    to = links.join(tree, "id").join(tree.select(F.col("id").alias("near"), F.col("tree").alias("other")), "near").filter("tree != other")
    if published is not None:
        locked = published.select("topic")
        to = to.join(locked.withColumnRenamed("topic", "tree"), "tree", "left_anti").join(locked.withColumnRenamed("topic", "other"), "other", "left_anti")
    merges = cut(to.groupBy(F.least("tree", "other").alias("a"), F.greatest("tree", "other").alias("b")).agg(F.min("id").alias("time"), F.min_by("tree", "id").alias("winner")))

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict[int, int] = {}

        def root(t: int) -> int:
            while parent.setdefault(t, t) != t:
                parent[t] = parent[parent[t]]
                t = parent[t]
            return t

        for m in pdf.sort_values(["time", "a", "b"]).itertuples():
            parent[root(m.b if m.winner == m.a else m.a)] = root(m.winner)
        return pd.DataFrame({"tree": list(parent), "topic": [root(t) for t in list(parent)]})

    grouped = merges.join(components(merges.select("a", "b")).withColumnRenamed("node", "a"), "a")
    topics = grouped.groupBy("root").applyInPandas(replay, "tree long, topic long")
    return tree.join(topics, "tree", "left").select("id", F.coalesce("topic", "tree").alias("topic"))


def _open_rows(rows: DataFrame, low: float | None, most: int) -> DataFrame:
    """``rows`` of undecided names without those that have no more say, with ``place`` among the name's unsure ones.

    Of the unsure ones only those count that fewer than ``most`` canonicals precede, down to the last that the oracle calls the same.
    """
    if low is None:
        return rows.withColumn("place", F.lit(None).cast("int"))
    order = Window.partitionBy("name", "sure").orderBy(F.desc("score"), F.asc("other"))
    before = F.coalesce(F.sum(F.col("canon").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("place", F.row_number().over(order)).withColumn("before", before).filter(F.col("sure") | (F.col("before") < most))
    after = F.max("same").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return placed.withColumn("after", after).filter("sure or after").drop("before", "after")


def _in_rounds(names: DataFrame, near: DataFrame, low: float | None, most: int, replay_rows: int) -> DataFrame:
    """:func:`resolve` in rounds over all names, each decided as soon as what is left open cannot change it; the pairs shrink every round, and the last ``replay_rows`` are replayed in one task.

    A name is a member when a sure canonical is known, or one that the oracle calls the same is of the ``most`` best whatever the open ones become;
    it is canonical when nothing is left that could make it a member.
    """
    rows = cut(_open_rows(near.withColumn("canon", F.lit(False)), low, most))
    left, decided = names, []
    while True:
        asked = F.lit(False) if low is None else ~F.col("sure") & F.col("same") & (F.col("place") <= most)
        per = rows.groupBy("name").agg(F.max(F.col("canon") & (F.col("sure") | asked)).alias("hit"))
        state = cut(left.join(per, "name", "left").withColumn("role", F.when(F.col("hit"), "member").when(F.col("hit").isNull(), "canonical")))
        decided.append(state.filter("role is not null").select("name", "role"))
        left = state.filter("role is null").select("name")
        kept = rows.join(left, "name", "left_semi").drop("place")
        known = decided[-1].select(F.col("name").alias("other"), F.col("role").alias("now"))
        kept = kept.join(known, "other", "left").filter("now is null or now = 'canonical'")
        rows = cut(_open_rows(kept.withColumn("canon", F.col("canon") | F.col("now").eqNullSafe("canonical")).drop("now"), low, most))
        if rows.count() <= replay_rows:
            break
    last = rows.withColumn("all_", F.lit(0)).groupBy("all_").applyInPandas(_replayed(low, most), "name string, canonical string")
    found = left.join(last, "name", "left").select("name", F.when(F.coalesce("canonical", "name") == F.col("name"), "canonical").otherwise("member").alias("role"))
    for some in decided:
        found = found.union(some)
    state = cut(found)
    canon = near.join(state.filter("role = 'canonical'").select(F.col("name").alias("other")), "other").join(state.filter("role = 'member'").select("name"), "name", "left_semi")
    best = canon.filter("sure").groupBy("name").agg(F.max(F.struct("score", "other"))["other"].alias("best"))
    out = state.join(best, "name", "left")
    said = F.lit(None).cast("string")
    if low is not None:
        first = top_n(canon.filter("not sure"), ["name"], [F.desc("score"), F.asc("other")], most).filter("same").groupBy("name").agg(F.min_by("other", F.struct(-F.col("score"), "other")).alias("said"))
        out, said = out.join(first, "name", "left"), F.col("said")
    return out.select("name", F.when(F.col("role") == "canonical", F.col("name")).otherwise(F.coalesce("best", said)).alias("canonical"))


def _replayed(low: float | None, most: int):
    """:func:`resolve` over at most ``replay_rows`` pairs, every name after all that it resembles before it."""

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, list[tuple[float, str, bool, bool]]] = {}
        later: dict[str, list[str]] = {}
        for name, other, score, sure, same in zip(pdf["name"], pdf["other"], pdf["score"], pdf["sure"], pdf["same"]):
            near.setdefault(name, []).append((score, other, sure, bool(same)))
            near.setdefault(other, [])
            later.setdefault(other, []).append(name)
        waiting = {n: len(x) for n, x in near.items()}
        ready, found = [n for n, k in waiting.items() if not k], {}
        while ready:
            name = ready.pop()
            canon = [x for x in near[name] if found[x[1]] == x[1]]
            best = max(((s, o) for s, o, sure, _ in canon if sure), default=None)
            if best is None and low is not None:
                asked = sorted((-s, o, same) for s, o, sure, same in canon if not sure)[:most]
                best = next(((-s, o) for s, o, same in asked if same), None)
            found[name] = name if best is None else best[1]
            for n in later.get(name, []):
                waiting[n] -= 1
                if not waiting[n]:
                    ready.append(n)
        return pd.DataFrame({"name": list(found), "canonical": list(found.values())})

    return replay


def resolve(names: DataFrame, earlier: DataFrame, sure: float, low: float | None = None, most: int = 3, replay_rows: int = 200_000) -> DataFrame:
    """(name, canonical): names in order join a canonical name or become one.

    ``earlier`` (name, other, score[, same]) holds similar pairs, ``other`` before ``name`` in the
    order. The best canonical at ``sure`` is joined; if none, of the ``most`` best canonicals between
    ``low`` and ``sure`` the first that an oracle calls the ``same``. Up to ``replay_rows`` pairs are replayed in order in one
    task; more, which no task should hold, go in rounds over all names until no more are left than that, with the same result.
    """
    known = names.select("name").distinct()
    near = earlier.withColumn("sure", F.col("score") >= sure)
    near = near.filter("sure") if low is None else near.filter(F.col("score") > low)
    near = near.join(known, "name", "left_semi").join(known.withColumnRenamed("name", "other"), "other", "left_semi")
    same = F.coalesce("same", F.lit(False)) if "same" in earlier.columns else F.lit(False)
    near = cut(near.select("name", "other", "score", "sure", same.alias("same")))
    if near.count() > replay_rows:
        return _in_rounds(known, near, low, most, replay_rows)
    done = near.withColumn("all_", F.lit(0)).groupBy("all_").applyInPandas(_replayed(low, most), "name string, canonical string")
    return known.join(done, "name", "left").select("name", F.coalesce("canonical", "name").alias("canonical"))


def canonical_names(names: DataFrame, pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(name, canonical): names by falling count join their best canonical at ``threshold`` or become one.

    ``names`` (name, n) is a dictionary, ``pairs`` (name, other, score) its similar pairs, one way or both.
    """
    place = names.select("name", F.struct(-F.col("n"), "name").alias("place"))
    both = pairs.join(place, "name").join(place.select(F.col("name").alias("other"), F.col("place").alias("before")), "other").filter("before <> place")
    later = F.col("before") < F.col("place")
    ways = both.select(F.when(later, F.col("name")).otherwise(F.col("other")).alias("name"), F.when(later, F.col("other")).otherwise(F.col("name")).alias("other"), "score")
    return resolve(names, ways, threshold)
