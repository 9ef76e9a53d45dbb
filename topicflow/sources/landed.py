"""Readers of landed feeds, one per kind, to one item schema."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import html_to_text, keyword_hits, strip
from ..operators.dedup import top_n

ITEM = ["source_id", "external_id", "title", "url", "content", "published_at", "engagement", "summary", "subdomain_id"]


def _items(df: DataFrame, source: str, external: Column, title: Column, url: Column, content: Column, published: Column, engagement: Column) -> DataFrame:
    """Rows of ``ITEM``; a summary or subdomain of their own are kept where the feed has them."""
    own = lambda c: (F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c)
    return df.select(
        F.lit(source).alias("source_id"), external.cast("string").alias("external_id"), strip(title).alias("title"), url.alias("url"), content.alias("content"), published.cast("timestamp").alias("published_at"), engagement.cast("double").alias("engagement"), own("summary"), own("subdomain_id")
    )


def rss(df: DataFrame, source: str, cutoff: str, max_items: int = 15, fetched: str | None = None) -> DataFrame:
    """The feed's first entries, then the date limit; an entry without a date is as new as the fetch (now, if not given) and stays; blank ones out."""
    head = df.orderBy("position").limit(max_items)
    body = html_to_text(F.coalesce(F.nullif(F.trim("content"), F.lit("")), F.nullif(F.trim("summary"), F.lit("")), "description"))
    now = F.current_timestamp() if fetched is None else F.lit(fetched).cast("timestamp")
    dated = F.coalesce(F.col("published").cast("timestamp"), F.col("updated").cast("timestamp"))
    fresh = F.coalesce(dated >= F.lit(cutoff).cast("timestamp"), F.lit(True))
    out = _items(head.filter(fresh), source, F.col("link"), F.col("title"), F.col("link"), body, F.coalesce(dated, now), F.lit(None))
    return out.filter((F.coalesce("content", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))


def arxiv(df: DataFrame, source: str, cutoff: str, keywords: list[str], limit: int = 20) -> DataFrame:
    out = _items(df, source, F.col("id"), F.col("title"), F.col("link"), F.col("summary"), F.col("published"), keyword_hits(F.concat_ws(" ", "title", "summary"), keywords))
    return out.filter(F.col("published_at") >= F.lit(cutoff).cast("timestamp")).orderBy(F.desc("published_at"), "external_id").limit(limit)


def searched(df: DataFrame, source: str, key: str, cutoff: str, least: float, limit: int = 20, fallback: str | None = None) -> DataFrame:
    """Results of several queries: one row per id (first query, first place), limits, then the cap."""
    once = top_n(df, [key], [F.asc("query_no"), F.asc("position")])
    url = F.coalesce("url", F.concat(F.lit(fallback), F.col(key).cast("string"))) if fallback else F.col("url")
    out = _items(once.withColumn("order_", F.struct("query_no", "position")), source, F.col(key), F.col("title"), url, F.col("body"), F.col("created"), F.col("points"))
    return out.filter((F.col("published_at") >= F.lit(cutoff).cast("timestamp")) & (F.col("engagement") >= least) & (F.coalesce("title", F.lit("")) != "")).orderBy("published_at", "external_id").limit(limit)


def listing(df: DataFrame, source: str, least: float = 20, chars: int = 1000) -> DataFrame:
    """A hot listing: pinned and weak rows out, text cut."""
    kept = df.filter(~F.coalesce("stickied", F.lit(False)) & (F.col("score") >= least))
    return _items(kept, source, F.col("id"), F.col("title"), F.col("url"), F.left("selftext", F.lit(chars)), F.col("created"), F.col("score"))


def daily_papers(df: DataFrame, source: str, cutoff: str, least: float = 0, limit: int = 20, date: str | None = None) -> DataFrame:
    """Voted papers, addressed as arXiv abstracts so that they meet the arXiv source's rows; one day's list with ``date``."""
    day = df if date is None else df.filter(F.col("list_date") == date)
    url = F.concat(F.lit("https://arxiv.org/abs/"), F.col("paper_id").cast("string"))
    out = _items(day, source, F.col("paper_id"), F.col("title"), url, F.col("summary"), F.col("published"), F.col("upvotes"))
    return out.filter((F.col("engagement") >= least) & (F.col("published_at") >= F.lit(cutoff).cast("timestamp"))).orderBy(F.desc("engagement"), "external_id").limit(limit)


def questions(df: DataFrame, source: str, cutoff: str, least: float = 1, limit: int = 20, chars: int = 1500) -> DataFrame:
    """Questions of several tags: one row per id before any filter, mark-up to text, text cut."""
    once = top_n(df, ["question_id"], [F.asc("query_no"), F.asc("position")])
    out = _items(once, source, F.col("question_id"), F.col("title"), F.col("link"), F.left(html_to_text(F.col("body")), F.lit(chars)), F.col("created"), F.col("score"))
    return out.filter((F.col("published_at") >= F.lit(cutoff).cast("timestamp")) & (F.col("engagement") >= least)).orderBy("published_at", "external_id").limit(limit)


def starred(df: DataFrame, source: str, cutoff: str, least: float = 20, limit: int = 20) -> DataFrame:
    """Repositories of several searches: created after the cutoff, starred enough, one row per id, then the cap."""
    named = df.select("query_no", "position", F.col("repo_id").alias("id"), F.col("full_name").alias("title"), F.col("html_url").alias("url"), F.col("description").alias("body"), "created", F.col("stars").alias("points"))
    return searched(named, source, "id", cutoff, least, limit)


@F.pandas_udf(StructType([StructField("entries", StringType()), StructField("fault", StringType())]))
def _embedded(html: pd.Series) -> pd.DataFrame:
    """A page's board as JSON, or what is wrong with it.

    A page's scripts push their data as string literals; those are decoded and read as one text, in
    which a JSON decoder takes the value that follows the board's name, so brackets inside names are
    only characters.
    """
    decoder = json.JSONDecoder(strict=False)

    def found(page: str | None) -> tuple[str | None, str | None]:
        text = ""
        for push in re.finditer(r"push\(\[\d+,\s*(?=\")", page or ""):
            try:
                text += decoder.raw_decode(page, push.end())[0]
            except ValueError:
                return None, "broken_script"
        board = text.find('"leaderboard":{')
        entries = re.compile(r'"entries":\s*').search(text, board) if board >= 0 else None
        if entries is None:
            return None, "no_board"
        try:
            value, _ = decoder.raw_decode(text, entries.end())
        except ValueError:
            return None, "broken_entries"
        return (json.dumps(value), None) if isinstance(value, list) else (None, "broken_entries")

    return pd.DataFrame([found(page) for page in html], columns=["entries", "fault"])


def board_faults(pages: DataFrame) -> DataFrame:
    """(page_id, fault): pages of which no board can be read."""
    return pages.select("page_id", _embedded("html")["fault"].alias("fault")).filter("fault is not null")


def boards(pages: DataFrame, most: int = 15) -> DataFrame:
    """(page_id, rank, model, org, score, votes): the first places of the board embedded in each page; pages without are in :func:`board_faults`."""
    entry = "array<struct<modelDisplayName:string,modelKey:string,rank:int,modelOrganization:string,rating:double,votes:long>>"
    rows = pages.select("page_id", F.inline(F.from_json(_embedded("html")["entries"], entry)))
    model = F.coalesce(F.nullif("modelDisplayName", F.lit("")), F.nullif("modelKey", F.lit("")))
    kept = rows.select("page_id", "rank", model.alias("model"), F.col("modelOrganization").alias("org"), F.round("rating", 1).alias("score"), "votes").filter("rank is not null and model is not null")
    return top_n(kept, ["page_id"], [F.asc("rank"), F.asc("model")], most)


KINDS: dict[str, Callable[..., DataFrame]] = {"rss": rss, "arxiv": arxiv, "search": searched, "listing": listing, "papers": daily_papers, "questions": questions, "repositories": starred}


def read(spark: SparkSession, source: dict) -> DataFrame:
    """Items of one configured source: {kind, format, path, args}. Unknown kinds raise."""
    if source["kind"] not in KINDS:
        raise ValueError(f"unknown source kind: {source['kind']}")
    landed = spark.read.format(source.get("format", "json")).options(**source.get("options", {})).load(source["path"])
    return KINDS[source["kind"]](landed, source["id"], **source.get("args", {}))


def unknown_sources(sources: list[dict], only: list[str] | None) -> list[str]:
    """Ids asked for that no source has."""
    return sorted(set(only or []) - {s["id"] for s in sources})


def read_all(spark: SparkSession, sources: list[dict], only: list[str] | None = None) -> DataFrame:
    """All sources, or those in ``only``, with each source's name and weight; unknown ids are reported by ``unknown_sources``, not raised."""
    chosen = [s for s in sources if not only or s["id"] in only]
    out = spark.createDataFrame([], "source_id string, external_id string, title string, url string, content string, published_at timestamp, engagement double, summary string, subdomain_id string, source_name string, source_weight double")
    for s in chosen:
        named = read(spark, s).withColumn("source_name", F.lit(s.get("name", s["id"]))).withColumn("source_weight", F.lit(float(s.get("weight", 1.0))))
        out = out.unionByName(named, allowMissingColumns=True)
    return out
