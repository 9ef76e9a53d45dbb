"""Registered queries of model operators and of repairs that models decide; the models are stated functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import models
from ..functions.text import dedupe_key
from ..operators import gates, selection, state
from ..operators.dedup import backfilled
from .catalog import ARTICLES, AS_OF, articles, issues, table
from .flows import _scratch
from .queries import query, r6


def _counter():
    """An encoder without a model: characters, e's and blanks."""
    return lambda texts: [[float(len(t)), float(t.count("e")), float(t.count(" "))] for t in texts]


@query("""WITH t AS (SELECT doc_id AS id, source || ' ' || lang || chr(10) || left(coalesce(text, ''), 2000) AS t FROM documents),
  v AS (SELECT id, length(t)::DOUBLE AS a, (length(t) - length(replace(t, 'e', '')))::DOUBLE AS b, (length(t) - length(replace(t, ' ', '')))::DOUBLE AS c FROM t)
SELECT id, round(a / sqrt(a * a + b * b + c * c), 6) AS x, round(b / sqrt(a * a + b * b + c * c), 6) AS y, round(c / sqrt(a * a + b * b + c * c), 6) AS z FROM v""")
def encoded_documents(spark, sf_dir):
    """Title and text of all documents encoded, a content once."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat("source", F.lit(" "), "lang").alias("title"), "text")
    made = models.encode(d, "id", "title", "text", _counter, f"{_scratch(spark)}/vectors", chunks=2)
    return made.select("id", *[r6(F.col("vector")[k]).alias(c) for k, c in enumerate("xyz")])


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 10 <> 0 THEN upper(p_name) END AS reply,
  CASE WHEN p_size % 10 = 0 THEN 'asked to wait 386.2 s: RuntimeError: 429, please try again in 6m26.2s' END AS error FROM part""")
def rate_limited_calls(spark, sf_dir):
    """A model under a limit a minute: refusals of short waits are waited for, those of long ones fail with their reason."""

    def make():
        seen: set[str] = set()

        def ask(prompt):
            size, name = prompt.split("|", 1)
            if int(size) % 10 == 0:
                raise RuntimeError("429, please try again in 6m26.2s")
            if int(size) % 10 == 1 and prompt not in seen:
                seen.add(prompt)
                raise RuntimeError("429, please try again in 1.5s")
            return name.upper()

        return ask

    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("|", F.col("p_size").cast("string"), "p_name").alias("prompt"))
    return models.call(p, "id", "prompt", make, workers=8, per_minute=600.0, sleep=lambda s: None, clock=lambda: 0.0)


def _same_event(pairs):
    """The stated oracle: an article and another one speak of one event unless 5 divides 31 ids of the one and the other's."""
    return pairs.select("id", "other", ((F.col("id") * 31 + F.col("other")) % 5 != 0).alias("same"))


@query(f"""WITH {ARTICLES}, m AS (SELECT id, topic_id, TIMESTAMP '{AS_OF}' - to_days(CAST(age_days AS INTEGER)) AS published FROM art WHERE gate_status <> 'excluded'),
  c AS (SELECT topic_id FROM m GROUP BY 1 HAVING count(*) > 1),
  g AS (SELECT o_custkey % 97 AS topic_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS other FROM orders GROUP BY 1),
  a AS (SELECT m.topic_id, m.id AS anchor FROM m JOIN c ON c.topic_id = m.topic_id LEFT JOIN g ON g.topic_id = m.topic_id
        QUALIFY row_number() OVER (PARTITION BY m.topic_id ORDER BY coalesce((m.id * 31 + g.other) % 5 <> 0, FALSE) DESC, m.published, m.id) = 1),
  e AS (SELECT m.id, m.topic_id FROM m JOIN a ON a.topic_id = m.topic_id WHERE m.id <> a.anchor AND (m.id * 31 + a.anchor) % 5 = 0)
SELECT m.id, CASE WHEN e.id IS NULL THEN m.topic_id ELSE m.id + 1000000 END AS topic_id, e.id IS NULL AND m.topic_id IN (SELECT topic_id FROM e) AS void FROM m LEFT JOIN e ON e.id = m.id""")
def repair_false_merges(spark, sf_dir):
    """Articles that do not speak of their topic's anchor leave it; topics that lost some are scored anew."""
    a = articles(spark, sf_dir).filter("gate_status <> 'excluded'")
    members = a.select("topic_id", "id", F.col("source_id").alias("title"), "content", F.expr(f"date_sub(date'{AS_OF[:10]}', cast(age_days as int))").alias("published_at"))
    written = issues(spark, sf_dir).select((F.col("topic_id") % 97).alias("topic_id"), "id", F.col("cadence").alias("title"), F.col("cadence").alias("content"), F.col("issue_date").alias("created_at"), F.array("id").alias("source_ids"))
    done = state.repair_false_merges(members, written, _same_event, F.col("id") + 1_000_000)
    return done.articles.join(done.topics.select("topic_id", F.lit(True).alias("void")), "topic_id", "left").select("id", "topic_id", F.coalesce("void", F.lit(False)).alias("void"))


@query("""WITH p AS (SELECT doc_id AS id, CAST(DATE '2024-01-01' + CAST(doc_id % 12 AS INTEGER) AS VARCHAR) AS day, 'http://p/' || doc_id % 150 AS url, n_chars AS score, CAST(length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) AS BIGINT) AS chars, doc_id % 12 AS k FROM documents),
  b AS (SELECT * FROM p WHERE day BETWEEN '2024-01-03' AND '2024-01-10' QUALIFY row_number() OVER (PARTITION BY day ORDER BY score DESC, id) <= 20),
  o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY url ORDER BY day, score DESC, id) = 1)
SELECT id, day, url, CASE WHEN 35 - k > 30 THEN 'excluded' WHEN chars < 200 THEN 'signal_only' ELSE 'included' END AS gate FROM o WHERE CAST(substr(url, 10) AS INTEGER) % 7 <> 0""")
def backfill_days(spark, sf_dir):
    """Twenty papers a day of eight days into a pool that has some of their addresses, gated."""
    k = (F.col("doc_id") % 12).cast("int")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.date_add(F.lit("2024-01-01").cast("date"), k).cast("string").alias("day"), F.concat(F.lit("http://p/"), (F.col("doc_id") % 150).cast("string")).alias("url"), F.col("n_chars").alias("score"), "text")
    pool = d.select("url").distinct().filter(F.substring("url", 10, 9).cast("int") % 7 == 0).select(dedupe_key(F.col("url")).alias("dedupe_key"))
    new = backfilled(d, pool, "2024-01-03", "2024-01-10", 20, dedupe_key(F.col("url")))
    age = F.date_diff(F.lit("2024-02-05").cast("date"), F.col("day").cast("date"))
    return new.select("id", "day", "url", gates.intake(F.col("text"), age)["status"].alias("gate"))


@query("""WITH i AS (SELECT source, lang, url, title, n_chars AS score FROM (SELECT *, 'u' || doc_id % 300 AS url, 'd' || doc_id AS title FROM documents) QUALIFY row_number() OVER (PARTITION BY url ORDER BY n_chars DESC, title DESC) = 1),
  b AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY score DESC, url) <= 3)
SELECT source || '/' || lang AS key, 'digest of ' || count(*) || ': ' || string_agg('- ' || title || ' ' || url, ' ' ORDER BY score DESC, url) AS reply FROM b GROUP BY source, lang""")
def legacy_digest(spark, sf_dir):
    """A summary of the three best items of every source and language, written by a model (here one that counts and joins)."""
    items = table(spark, sf_dir, "documents").select("source", "lang", F.concat(F.lit("u"), (F.col("doc_id") % 300).cast("string")).alias("url"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("title"), F.col("n_chars").alias("score"))
    prompts = selection.digest_prompts(items, ["source", "lang"])
    return models.call(prompts, "key", "prompt", lambda: lambda p: f"digest of {len(p.splitlines())}: {' '.join(p.splitlines())}").select("key", "reply")
