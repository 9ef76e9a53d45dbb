"""Opaque models as operators: chat calls, encoders, rerankers. Filtered first, batched by partition, failures kept as rows."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sources.sinks import there

#: A refusal's own wait, in the form "try again in 6m26.2s", minutes optional.
WAIT = re.compile(r"try again in (?:(\d+)m(?!s))?(\d+(?:\.\d+)?)s", re.IGNORECASE)


def wait_of(error: Exception) -> float | None:
    """Seconds that a refusal asks to wait, None if it names none."""
    found = WAIT.search(str(error))
    return None if found is None else 60.0 * float(found[1] or 0) + float(found[2])


class Pace:
    """Calls at least ``gap`` seconds apart."""

    def __init__(self, gap: float, sleep: Callable[[float], None], clock: Callable[[], float]):
        self.gap, self.sleep, self.clock, self.free = gap, sleep, clock, None

    def __call__(self) -> None:
        now = self.clock()
        if self.free is not None and now < self.free:
            self.sleep(self.free - now)
            now = self.free
        self.free = now + self.gap


def call(
    df: DataFrame, key: str, prompt: str, make: Callable[[], Callable[[str], str]], attempts: int = 3, pauses: tuple[float, ...] = (2.0, 8.0), limit: int | None = None,
    workers: int | None = None, per_minute: float | None = None, longest_wait: float = 20.0, grace: float = 2.0, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic,
) -> DataFrame:
    """(key, reply, error): ``make`` builds the caller once a partition; an error never fails the task.

    After a failure the task waits as long as the refusal asks, ``grace`` seconds more, or where it names no time a pause (the
    last one again if there are more attempts). A wait over ``longest_wait`` is a quota that does not come back
    soon: the row fails at once, so a later run takes it up. ``workers`` is the number of partitions, so at most so many calls run at a
    time; ``per_minute`` bounds the calls of all of them together, each partition getting its share of it. ``limit`` bounds the
    queue by key before anything is asked.
    """
    if limit is not None:
        df = df.orderBy(key).limit(limit)
    if workers is None and per_minute is not None:
        workers = df.sparkSession.sparkContext.defaultParallelism
    rows = df.select(key, prompt)
    if workers is not None:
        rows = rows.repartition(workers)
    gap = 0.0 if per_minute is None else 60.0 * workers / per_minute

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, pace = make(), Pace(gap, sleep, clock)
        for part in parts:
            out = []
            for k, p in zip(part[key], part[prompt]):
                reply = error = None
                for n in range(attempts):
                    pace()
                    try:
                        reply, error = ask(p), None
                        break
                    except Exception as e:  # noqa: BLE001  what a model client raises is its own affair
                        error = f"{type(e).__name__}: {e}"
                        asked = wait_of(e)
                        if asked is not None and asked + grace > longest_wait:
                            error = f"asked to wait {asked:g} s: {error}"
                            break
                        wait = asked + grace if asked is not None else pauses[min(n, len(pauses) - 1)] if pauses else 0.0
                        if wait and n + 1 < attempts:
                            sleep(wait)
                out.append((k, reply, error))
            yield pd.DataFrame(out, columns=["key", "reply", "error"])

    kind = dict(df.dtypes)[key]
    return rows.mapInPandas(run, f"key {kind}, reply string, error string").withColumnRenamed("key", key)


def with_cache(df: DataFrame, cache: DataFrame, key: str, prompt: str, make, **how) -> DataFrame:
    """Replies from the cache where it has the key, calls for the rest."""
    known = df.join(cache.select(key, "reply"), key).selectExpr(key, "reply", "cast(null as string) as error")
    return known.unionByName(call(df.join(cache.select(key), key, "left_anti"), key, prompt, make, **how))


def encode(df: DataFrame, key: str, title: str, body: str, make: Callable[[], Callable[[list[str]], list[list[float]]]], cache: str, size: int = 64, chunks: int = 16, chars: int = 2000) -> DataFrame:
    """(key, vector, error): one vector a row from title and text, each different content encoded once, ever.

    Contents that the table at ``cache`` lacks are encoded chunk by chunk (a chunk is a share of the content
    hashes), each chunk appended when it is done: a run that stops goes on behind its last whole chunk. In a partition texts
    go by length, ``size`` of them a call, so that a call's texts are about as long as each other. A call that
    fails gives its rows the error, which the table keeps as well, and they are tried again in a later run. Vectors come to length one; a text is its title and the first
    ``chars`` characters of its body.
    """
    spark = df.sparkSession
    text = F.concat_ws("\n", F.nullif(F.trim(F.coalesce(F.col(title), F.lit(""))), F.lit("")), F.left(F.coalesce(F.col(body), F.lit("")), F.lit(chars)))
    keyed = df.select(key, text.alias("text")).withColumn("content", F.sha2("text", 256))
    schema = "content string, vector array<double>, error string"
    chunk = F.pmod(F.xxhash64("content"), F.lit(chunks))

    def known() -> DataFrame:
        return spark.read.schema(schema).parquet(cache) if there(spark, cache) else spark.createDataFrame([], schema)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()

        def encoded(some: pd.DataFrame) -> pd.DataFrame:
            vectors, error = [None] * len(some), None
            try:
                vectors = []
                for v in model(some["text"].tolist()):
                    length = sum(x * x for x in v) ** 0.5
                    vectors.append([x / length if length else 0.0 for x in v])
            except Exception as e:  # noqa: BLE001  as for calls
                vectors, error = [None] * len(some), f"{type(e).__name__}: {e}"
            return pd.DataFrame({"content": some["content"], "vector": vectors, "error": error})

        left = None
        for part in parts:  # a batch of texts may go over the edge of two Arrow batches
            left = part if left is None else pd.concat([left, part])
            whole = len(left) - len(left) % size
            for n in range(0, whole, size):
                yield encoded(left.iloc[n : n + size])
            left = left.iloc[whole:]
        if left is not None and len(left):
            yield encoded(left)

    for n in range(chunks):
        done = known().filter("error is null").select("content")
        todo = keyed.filter(chunk == n).groupBy("content").agg(F.first("text").alias("text")).join(done, "content", "left_anti")
        todo.repartition("content").sortWithinPartitions(F.length("text")).select("content", "text").mapInPandas(run, schema).write.mode("append").parquet(cache)
    found = known().groupBy("content").agg(F.first("vector", ignorenulls=True).alias("vector"), F.max("error").alias("error"))
    return keyed.join(found, "content", "left").select(key, "vector", F.when(F.col("vector").isNull(), F.col("error")).alias("error"))


def rerank(candidates: DataFrame, make_remote: Callable | None, make_local: Callable, most: int = 64) -> DataFrame:
    """(query_id, doc_id, score, step, error) of candidates (query_id, query, doc_id, document): the remote model, or the local one where that fails.

    A remote caller takes (query, documents) and gives (place, score) pairs in any order, a place left out counting 0; a local one gives scores in
    order and is built only when it is needed, once a task. A query's candidates go ``most`` to a call, a
    query with very many in calls of several tasks. ``step`` says which model gave the score; if both fail the
    score is null and ``error`` says why. Null queries and documents count as empty.
    """
    sizes = candidates.groupBy("query_id").agg(F.ceil(F.count("*") / most).alias("parts_"))
    dealt = candidates.select("query_id", "query", "doc_id", "document").join(sizes, "query_id").withColumn("part_", F.pmod(F.xxhash64("doc_id"), F.col("parts_")))
    tools: dict[str, Callable] = {}  # of a task: it gets its own copy

    def tool(name: str, make: Callable) -> Callable:
        if name not in tools:
            tools[name] = make()
        return tools[name]

    def scores(query: str, documents: list[str]) -> tuple[list, str | None, str | None]:
        error = None
        if make_remote is not None:
            try:
                found = [0.0] * len(documents)
                for place, score in tool("remote", make_remote)(query, documents):
                    found[place] = float(score)
                return found, "remote", None
            except Exception as e:  # noqa: BLE001  whatever a client raises, the local model is next
                error = f"{type(e).__name__}: {e}"
        try:
            return [float(s) for s in tool("local", make_local)(query, documents)], "local", error
        except Exception as e:  # noqa: BLE001
            return [None] * len(documents), None, f"{type(e).__name__}: {e}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for part in parts:  # a call's rows may go over the edge of two Arrow batches
            left = part if left is None else pd.concat([left, part], ignore_index=True)
            starts = _starts(left)
            yield scored(left.iloc[: starts[-1]], starts)
            left = left.iloc[starts[-1] :]
        if left is not None:
            yield scored(left, [*_starts(left), len(left)])

    def scored(rows: pd.DataFrame, starts) -> pd.DataFrame:
        queries, documents = rows["query"].tolist(), rows["document"].tolist()
        out: tuple[list, list, list] = ([], [], [])
        for a, z in zip(starts, starts[1:]):
            for n in range(a, z, most):
                some = [d or "" for d in documents[n : min(z, n + most)]]
                found, step, error = scores(queries[n] or "", some)
                for column, values in zip(out, (found, [step] * len(some), [error] * len(some))):
                    column.extend(values)
        columns = {c: pd.Series(v, dtype=t) for c, v, t in zip(("score", "step", "error"), out, ("float64", object, object))}
        return pd.DataFrame({"query_id": rows["query_id"].reset_index(drop=True), "doc_id": rows["doc_id"].reset_index(drop=True), **columns})

    kinds = dict(candidates.dtypes)
    calls = dealt.repartition("query_id", "part_").sortWithinPartitions("query_id", "part_", "doc_id")
    return calls.mapInPandas(run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double, step string, error string")


def _starts(rows: pd.DataFrame) -> list[int]:
    """Where the calls of ``rows`` begin, which are in order of query and part; the last one may go on."""
    ids = rows["query_id"]
    new = (ids != ids.shift()) & ~(ids.isna() & ids.shift().isna()) | (rows["part_"] != rows["part_"].shift())
    return new.to_numpy().nonzero()[0].tolist()
