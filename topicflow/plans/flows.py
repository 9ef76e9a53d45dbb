"""Registered queries of feeds, streams, state changes, selection ledgers and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import gates, graph, ranks, replies, resolution, scoring, selection, state
from ..operators.dedup import top_n
from ..operators.lineage import shared_folder
from ..sources import landed
from ..streaming import assign, ingest
from .catalog import ARTICLES, SCORES, articles, issues, module_scores, score_maps, table
from .queries import GROUP_CAPS, ROTATION, SQL, TIER_CAPS, TYPE_CAPS, html_sql, query, r6, rotation_input, rotation_picks

# feeds ------------------------------------------------------------------------------------------

FEED_DAY = "CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS VARCHAR)"


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).cast("string")
    link = F.concat(F.lit("https://x/"), F.col("doc_id").cast("string"))
    return d.select(F.col("doc_id").alias("position"), "doc_id", F.concat("source", F.lit(" "), "lang").alias("title"), link.alias("link"), "text", "n_chars", day.alias("published"))


def _shown(items: DataFrame) -> DataFrame:
    return items.select("external_id", "title", "url", F.length("content").cast("long").alias("chars"), F.date_format("published_at", "yyyy-MM-dd").alias("day"), "engagement")


FEED_COLUMNS = f"CAST(doc_id AS VARCHAR) AS external_id, source || ' ' || lang AS title, 'https://x/' || doc_id AS url"


@query(f"""SELECT {FEED_COLUMNS}, CAST(least(length(text), 1000) AS BIGINT) AS chars, {FEED_DAY} AS day, CAST(n_chars AS DOUBLE) AS engagement FROM documents WHERE doc_id % 10 <> 0 AND n_chars >= 500""")
def source_listing(spark, sf_dir):
    """A hot listing; every tenth row is pinned."""
    f = _feed(spark, sf_dir).select(F.col("doc_id").alias("id"), "title", F.col("link").alias("url"), F.col("text").alias("selftext"), F.col("published").alias("created"), F.col("n_chars").alias("score"), (F.col("doc_id") % 10 == 0).alias("stickied"))
    return _shown(landed.listing(f, "listing", 500))


@query(f"""SELECT {FEED_COLUMNS}, CAST(length(text) AS BIGINT) AS chars, {FEED_DAY} AS day,
    CAST(CASE WHEN contains(lower(source || ' ' || lang || ' ' || text), 'tion') THEN 1 ELSE 0 END + CASE WHEN contains(lower(source || ' ' || lang || ' ' || text), 'src1') THEN 1 ELSE 0 END AS DOUBLE) AS engagement
  FROM documents WHERE doc_id % 30 >= 14 ORDER BY doc_id % 30 DESC, CAST(doc_id AS VARCHAR) LIMIT 20""")
def source_arxiv(spark, sf_dir):
    """The newest entries, scored by keywords."""
    f = _feed(spark, sf_dir).select(F.col("doc_id").alias("id"), "title", "link", F.col("text").alias("summary"), "published")
    return _shown(landed.arxiv(f, "arxiv", "2024-01-15", ["tion", "src1"]))


@query("""WITH x AS (SELECT user_id, event_id, ts, value, event_type, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS q FROM events),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY q, event_id) AS k FROM x)
SELECT CAST(user_id AS VARCHAR) AS external_id, event_type AS title, 'https://x/' || user_id AS url, CAST(length(event_type) AS BIGINT) AS chars, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, value AS engagement
FROM r WHERE k = 1 AND ts >= TIMESTAMP '2024-01-05' AND value >= 20 ORDER BY ts, CAST(user_id AS VARCHAR) LIMIT 20""")
def source_search(spark, sf_dir):
    """Three searches with the same hits: first query, first place."""
    no = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    e = table(spark, sf_dir, "events").select(no.alias("query_no"), F.col("event_id").alias("position"), F.col("user_id").alias("hit"), F.col("event_type").alias("title"), F.lit(None).cast("string").alias("url"), F.col("event_type").alias("body"), F.col("ts").alias("created"), F.col("value").alias("points"))
    return _shown(landed.searched(e, "search", "hit", "2024-01-05", 20, fallback="https://x/"))


@query(f"""SELECT url AS external_id, trim(url) AS title, url, CAST(length({html_sql('html')}) AS BIGINT) AS chars, CASE WHEN page_id % 4 = 0 THEN '2024-01-31' ELSE '2024-01-20' END AS day, NULL::DOUBLE AS engagement
  FROM (SELECT * FROM pages ORDER BY page_id LIMIT 15) p WHERE {html_sql('html')} <> '' AND url <> ''""")
def source_rss(spark, sf_dir):
    """A feed of web pages, their mark-up as content; one in four has no date."""
    p = table(spark, sf_dir, "pages")
    none = F.lit(None).cast("string")
    f = p.select(F.col("page_id").alias("position"), F.col("url").alias("title"), F.col("url").alias("link"), F.col("html").alias("content"), none.alias("summary"), none.alias("description"), F.when(F.col("page_id") % 4 != 0, "2024-01-20").alias("published"), none.alias("updated"))
    return _shown(landed.rss(f, "rss", "2024-01-01", fetched="2024-01-31"))


# streams ----------------------------------------------------------------------------------------


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/flow-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, whether it is one file or a folder of them: a glob takes either."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/{name}.parque[t]")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, their times as instants: days and hours are those of UTC, whatever the session's zone."""
    return _stream(spark, sf_dir, "events").withColumn("ts", F.expr("cast(convert_timezone('UTC', current_timezone(), ts) as timestamp)"))


def _utc(instant: str):
    return F.expr(f"convert_timezone(current_timezone(), 'UTC', cast({instant} as timestamp_ntz))")


def _finish(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


@query("""SELECT CAST(CAST(ts AS DATE) - CAST(k AS INTEGER) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(7) r(k) GROUP BY 1, 2""")
def stream_windowed_counts(spark, sf_dir):
    """Sliding weeks, one a day, over the events as a stream."""
    out = _scratch(spark)
    counts = ingest.windowed_counts(_events(spark, sf_dir))
    _finish(ingest.keep_changes(counts, f"{out}/rows", f"{out}/state"))
    rows = ingest.last_changes(spark, f"{out}/rows", ["window", "event_type"], counts)
    return rows.select(F.to_date(_utc("window.start")).cast("string").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH k AS (SELECT url, lower(rtrim(trim(url), '/')) AS dedupe_key FROM pages) SELECT dedupe_key, min(url) AS url FROM k GROUP BY dedupe_key""")
def stream_ingest(spark, sf_dir):
    """Pages as a stream into an empty pool."""
    pages = _stream(spark, sf_dir, "pages").select("url", F.col("html").alias("content"), F.lit("2024-01-20").cast("timestamp").alias("published_at"))
    out = _scratch(spark)
    _finish(ingest.start(pages, f"{out}/pool", f"{out}/state", "2024-01-31"))
    return ingest.pooled(spark, f"{out}/pool", pages).select("dedupe_key", "url")


@query()
def stream_topics(spark, sf_dir):
    """Vectors as a stream, each label a bucket of the stateful assignment."""
    v = _stream(spark, sf_dir, "embeddings").select(F.col("label").alias("bucket"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    out = _scratch(spark)
    _finish(assign.start(v, f"{out}/changes", f"{out}/state", 0.35))
    return assign.topics(spark, f"{out}/changes")


# state ------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT DISTINCT o_custkey AS topic_id FROM orders), p AS (SELECT o_custkey AS topic_id, max(o_orderkey) AS issue_id FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT topic_id, p.issue_id AS published_issue_id, CAST(NULL AS BIGINT) AS weekly_issue_id FROM t LEFT JOIN p USING (topic_id)""")
def mark_published(spark, sf_dir):
    o = issues(spark, sf_dir)
    none = F.lit(None).cast("long")
    topics = o.select("topic_id").distinct().select("topic_id", none.alias("published_issue_id"), none.alias("weekly_issue_id"))
    return state.mark_published(topics, o.filter("cadence = '1-URGENT'").select("topic_id", F.col("id").alias("issue_id")), "daily")


@query("""SELECT p_partkey AS id, p_size > 25 AS is_release, CASE WHEN p_size > 25 THEN CASE lower(trim(p_brand)) WHEN 'brand#1' THEN 'One' ELSE trim(p_brand) END END AS vendor, CASE WHEN p_size > 25 THEN p_type END AS kind, 'now' AS checked_at FROM part""")
def save_release(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    none = F.lit(None).cast("string")
    old = p.select(F.col("p_partkey").alias("id"), F.lit(False).alias("is_release"), F.lit("old").alias("vendor"), F.lit("old").alias("kind"), none.alias("checked_at"))
    checked = p.select(F.col("p_partkey").alias("id"), (F.col("p_size") > 25).alias("is_release"), F.col("p_brand").alias("vendor"), F.col("p_type").alias("kind"))
    return state.save_release(old, checked, F.lit("now"), text.canonical(F.col("vendor"), {"brand#1": "One"}))


@query(f"""WITH {ARTICLES} SELECT id, CASE WHEN gate_status = 'signal_only' THEN id + 1000000 ELSE topic_id END AS topic_id FROM art""")
def split_false_merges(spark, sf_dir):
    """Members without substance leave their topics."""
    a = articles(spark, sf_dir)
    out, _ = state.split_members(a.select("id", "topic_id"), a.filter("gate_status = 'signal_only'").select("id"), F.col("id") + 1_000_000)
    return out


@query("""SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS issue_date, 'weekly' AS cadence FROM orders WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderpriority = '1-URGENT')""")
def issue_guard(spark, sf_dir):
    """Days still without a weekly issue; urgent ones stand for issues made."""
    o = issues(spark, sf_dir).select(F.col("issue_date").cast("string").alias("issue_date"), "cadence")
    done = o.filter("cadence = '1-URGENT'").select("issue_date", F.lit("weekly").alias("cadence"))
    return state.new_issues(done, o.select("issue_date", F.lit("weekly").alias("cadence")).distinct())


@query("""WITH m AS (SELECT lower(trim(p_brand)) AS name, p_brand AS alias, p_type AS kind, p_partkey AS arrival FROM part)
SELECT name, arg_min(kind, arrival) AS kind, coalesce(string_agg(DISTINCT alias, ',' ORDER BY alias) FILTER (alias <> name), '') AS aliases FROM m GROUP BY name""")
def graph_merge_entities(spark, sf_dir):
    m = table(spark, sf_dir, "part").select(F.lower(F.trim("p_brand")).alias("name"), F.col("p_brand").alias("alias"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("arrival"))
    none = spark.createDataFrame([], "name string, kind string, aliases array<string>")
    return graph.merged_entities(none, m).select("name", "kind", F.array_join("aliases", ",").alias("aliases"))


@query("""SELECT l_orderkey AS article_id, CAST(l_partkey AS VARCHAR) AS subject, l_returnflag AS relation, CAST(l_suppkey AS VARCHAR) AS object FROM lineitem""")
def graph_triples(spark, sf_dir):
    """Replies with one triple each, prose around them."""
    t = F.struct(F.col("l_partkey").cast("string").alias("subject"), F.lit("part").alias("subject_type"), F.col("l_returnflag").alias("relation"), F.col("l_suppkey").cast("string").alias("object"), F.lit("supplier").alias("object_type"))
    reply = F.concat(F.lit("Here: "), F.to_json(F.struct(F.array(t).alias("triples"))), F.lit(" done"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article_id"), reply.alias("reply"))
    return graph.from_triples(li).select("article_id", "subject", "relation", "object")


@query()
def entity_resolution(spark, sf_dir):
    """Vectors as entities in order of id; an oracle that knows their labels is asked in the grey zone."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("place"), F.col("embedding").alias("vector"), F.col("label").alias("kind"))
    return resolution.canonical_vectors(v, 0.45, 0.3)


# selection --------------------------------------------------------------------------------------



def _full_sql(kind: str, caps: dict) -> str:
    return f"(SELECT count(*) FROM pk JOIN ca p USING (id) WHERE p.key = ca.key AND p.{kind} = ca.{kind}) >= coalesce(CASE ca.{kind} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in caps.items()) + " END, 1000000)"


@query(f"""WITH RECURSIVE {ROTATION} SELECT ca.key, ca.id, CASE WHEN via IS NULL THEN 'rejected' ELSE 'selected' END AS decision,
  coalesce(via, CASE WHEN top < 6 THEN 'below_module_threshold' WHEN {_full_sql('type', TYPE_CAPS)} THEN 'content_type_quota_full' WHEN {_full_sql('grp', GROUP_CAPS)} THEN 'module_group_quota_full' WHEN {_full_sql('tier', TIER_CAPS)} THEN 'tier_quota_full' ELSE 'slots_full' END) AS reason
FROM ca LEFT JOIN pk ON pk.id = ca.id""")
def rotation_ledger(spark, sf_dir):
    """Every candidate of four issues with its decision and reason."""
    s = rotation_input(spark, sf_dir)
    every = s.groupBy("key", "id", "content_type", "tier", "grp").agg(F.max("score").alias("top_score"))
    return selection.ledger(every, rotation_picks(s), types=TYPE_CAPS, tiers=TIER_CAPS, groups=GROUP_CAPS)


@query(f"""SELECT id % 97 AS topic_id, count(DISTINCT key) AS days FROM ({SQL['rotation_ledger']}) l WHERE key IN ('issue0', 'issue1', 'issue2') AND (decision = 'selected' OR reason LIKE '%_full') GROUP BY 1""")
def qualified_days_of_ledger(spark, sf_dir):
    """Days on which a topic was chosen or only lacked a place, from the ledger of three daily issues; the fourth is a weekly one."""
    k = F.substring("key", 6, 1).cast("int")
    day = F.date_add(F.lit("2024-01-01").cast("date"), k).cast("string")
    trace = rotation_ledger(spark, sf_dir).select((F.col("id") % 97).alias("topic_id"), "decision", "reason", day.alias("issue_date"), F.when(k == 3, "weekly").otherwise("daily").alias("cadence"))
    return scoring.qualified_days(trace, "daily", "2024-01-01", "2024-01-04")


@query("""SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_returnflag = 'R' AND l_quantity < 5 THEN 'insufficient_sources' WHEN l_tax > 0.07 THEN 'generation_error' WHEN l_discount > 0.09 THEN 'failed_selfcheck'
    WHEN l_quantity / 50 < 0.6 AND l_linenumber < 2 THEN 'regenerate' WHEN l_quantity / 50 < 0.8 THEN 'needs_review' ELSE 'ready' END AS outcome FROM lineitem""")
def generation_outcome(spark, sf_dir):
    none = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") < 5), 0).otherwise(1)
    review = F.struct(F.struct(F.lit(True).alias("headline_matches_body"), (~(F.col("l_discount") > 0.09)).alias("single_subject"), F.array().cast("array<string>").alias("unrelated_sources")).alias("coherence_check"))
    o = selection.outcome(none, F.when(F.col("l_tax") > 0.07, "boom"), replies.coherent(review), F.col("l_quantity") / 50, F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), o.alias("outcome"))


@query("""SELECT o_orderkey AS id, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey || '-7'), o_orderkey) - 1) % 5 AS INTEGER) AS technique FROM orders""")
def technique_round_robin(spark, sf_dir):
    """A seeded permutation of each cadence's issues, dealt to five techniques in turn."""
    o = issues(spark, sf_dir).select("id", "cadence", F.md5(F.concat(F.col("id").cast("string"), F.lit("-7"))).alias("shuffled"))
    return ranks.row_numbers(o, ["cadence"], ["shuffled", "id"], "n").select("id", F.pmod(F.col("n") - 1, F.lit(5)).cast("int").alias("technique"))


# evaluation -------------------------------------------------------------------------------------


@query(f"""WITH {SCORES}, r AS (SELECT id, module, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, module) AS k FROM sc), g AS (SELECT id, count(*) FILTER (k <= 3 AND module = id % 18) > 0 AS hit, count(*) FILTER (score >= 8 AND module <> id % 18) AS high, count(*) FILTER (module <> id % 18) AS n FROM r GROUP BY id)
SELECT round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS top3_hit, round(sum(high) / sum(n), 6) AS false_high FROM g""")
def eval_top3_hit(spark, sf_dir):
    """Scores against one relevant module a topic."""
    r = score_maps(spark, sf_dir)
    order = F.transform(F.map_entries("scores"), lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("key")))
    top3 = F.transform(F.slice(F.array_sort(order), 1, 3), lambda e: e["key"].cast("long"))
    other = F.filter(F.map_entries("scores"), lambda e: e["key"] != F.col("id") % 18)
    each = r.select(F.array_contains(top3, F.col("id") % 18).cast("double").alias("hit"), F.size(F.filter(other, lambda e: e["value"] >= 8)).alias("high"), F.size(other).alias("n"))
    return each.agg(r6(F.avg("hit")).alias("top3_hit"), r6(F.sum("high") / F.sum("n")).alias("false_high"))


@query(f"""WITH {SCORES}, g AS (SELECT id % 97 AS topic, module, max(score) - min(score) AS spread FROM sc GROUP BY 1, 2) SELECT module, round(avg(spread), 6) AS mean, round(median(spread), 6) AS med, round(max(spread), 6) AS most FROM g GROUP BY module""")
def eval_score_spread(spark, sf_dir):
    g = module_scores(spark, sf_dir).groupBy(F.col("id") % 97, "module").agg((F.max("score") - F.min("score")).alias("spread"))
    return g.groupBy("module").agg(r6(F.avg("spread")).alias("mean"), r6(F.median("spread")).alias("med"), r6(F.max("spread")).alias("most"))


@query("""SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, count(*) AS n, count(*) FILTER (o_totalprice < 100000) AS needs_review, round(avg(o_totalprice), 6) AS confidence FROM orders GROUP BY 1""")
def backfill_summary(spark, sf_dir):
    return issues(spark, sf_dir).groupBy(F.col("issue_date").cast("string").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("score") < 100000).alias("needs_review"), r6(F.avg("score")).alias("confidence"))


@query("SELECT topic_id FROM (SELECT DISTINCT o_custkey AS topic_id FROM orders) ORDER BY md5(topic_id || '-42'), topic_id LIMIT 50")
def seeded_sample(spark, sf_dir):
    """Fifty topics by a seeded order."""
    seeded = F.md5(F.concat(F.col("topic_id").cast("string"), F.lit("-42")))
    return issues(spark, sf_dir).select("topic_id").distinct().orderBy(seeded, "topic_id").limit(50)


@query(f"""WITH {ARTICLES} SELECT count(*) AS n FROM art WHERE gate_reason IS DISTINCT FROM CASE WHEN age_days > 20 THEN 'published_out_of_window' WHEN chars < 300 THEN 'title_only' ELSE '' END""")
def regate_changes(spark, sf_dir):
    """Rows whose reason changes under other limits."""
    a = articles(spark, sf_dir)
    new = gates.intake(F.col("content"), F.col("age_days"), 20, 300)["reason"]
    return a.agg(F.count_if(~F.col("gate_reason").eqNullSafe(new)).alias("n"))


@query(f"""WITH {ARTICLES} SELECT topic_id, count(*) AS n FROM art WHERE gate_status <> 'excluded' GROUP BY topic_id HAVING count(*) > 1""")
def crowded_topics(spark, sf_dir):
    return articles(spark, sf_dir).filter("gate_status <> 'excluded'").groupBy("topic_id").agg(F.count("*").alias("n")).filter("n > 1")


# texts ------------------------------------------------------------------------------------------


@query("""SELECT p_partkey AS id, 'Name: ' || p_name || '; kind ' || p_type AS prompt, trim(p_name) AS system FROM part""")
def prompt_render(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    made = text.rendered("Name: {{name}}; kind {{ kind }}", {"name": F.col("p_name"), "kind": F.col("p_type")})
    system = text.tagged_part(F.concat(F.lit("<system> "), "p_name", F.lit("\n</system><user>x</user>")), "system")
    return p.select(F.col("p_partkey").alias("id"), made.alias("prompt"), system.alias("system"))


@query("""SELECT conv_id, CAST(count(*) FILTER (NOT (turn = 0 OR role = 'user')) AS BIGINT) AS kept FROM conversations GROUP BY conv_id""")
def sections_without_echo(spark, sf_dir):
    """Turns as sections; those of the user repeat the insight's heading, the first one its text."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.struct(F.col("role").alias("heading"), F.array(F.when(F.col("turn") == 0, "echo").otherwise("text")).alias("paragraphs")).alias("s"))
    rows = c.groupBy("conv_id").agg(F.collect_list("s").alias("s"))
    return rows.select("conv_id", F.size(text.without_echo(F.col("s"), F.lit("user"), F.array(F.lit("echo")))).cast("long").alias("kept"))


@query("""SELECT doc_id AS id, CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'en' END AS lang, translate(source, 'src', 'SrC') AS source FROM documents""")
def language_fallback(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), text.one_of(F.col("lang"), ["en", "de"], "en").alias("lang"), text.mapped_characters(F.col("source"), {"s": "S", "r": "R", "c": "C"}, keep="r").alias("source"))


@query("""WITH t AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) SELECT user_id, event_id, CAST(k AS BIGINT) AS place FROM t WHERE k <= 10""")
def leaderboard(spark, sf_dir):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).cast("long")
    best = top_n(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.asc("event_id")], 10)
    return best.select("user_id", "event_id", place.alias("place"))
