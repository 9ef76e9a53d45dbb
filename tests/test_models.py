"""Encoders, rerankers, waits and limits, and repairs that a model decides."""

import os
import random
import sys
from collections import Counter

from pyspark import cloudpickle
from pyspark.sql import functions as F
from topicflow import models
from topicflow.operators import state

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this module


def noted(path):
    """A function that appends what it is given to a file: seen by the test whatever process calls it."""
    return lambda x: os.write(os.open(path, os.O_CREAT | os.O_APPEND | os.O_WRONLY), f"{x}\n".encode()) and None


def lines(path):
    return open(path).read().split("\n")[:-1] if os.path.exists(path) else []


def test_contents_are_encoded_once_also_after_a_stop(spark, tmp_path):
    calls, cache = str(tmp_path / "calls"), str(tmp_path / "cache")

    def make(stop=None):
        def build():
            note = noted(calls)

            def encoder(texts):
                assert len(texts) <= 8 and [len(t) for t in texts] == sorted(len(t) for t in texts)
                for t in texts:
                    note(t.replace("\n", "/"))
                if stop and any(stop in t for t in texts):
                    raise MemoryError("too long")
                return [[3.0, 4.0 * (len(t) > 1)] for t in texts]

            return encoder

        return build

    rows = [(k, f"t{k % 40}", "x" * (k % 40) if k % 40 else None) for k in range(120)] + [(200, "bad", "bad"), (201, None, None), (202, "", "")]
    df = spark.createDataFrame(rows, "id long, title string, body string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)  # calls go over the edges of batches
    try:
        part = df.filter("id < 60 or id >= 200")
        got = {r["id"]: (r["vector"], r["error"]) for r in models.encode(part, "id", "title", "body", make("bad"), cache, size=8, chunks=3).collect()}
        bad = [k for k, (v, e) in got.items() if e]
        assert 200 in bad and all(got[k][0] is None and got[k][1] == "MemoryError: too long" for k in bad)
        assert all(v == [0.6, 0.8] for k, (v, e) in got.items() if not e and k < 200) and got[201] == got[202]
        first = Counter(lines(calls))
        assert max(first.values()) == 1
        got = {r["id"]: (r["vector"], r["error"]) for r in models.encode(df, "id", "title", "body", make(), cache, size=8, chunks=3).collect()}
        assert all(v is not None and e is None for v, e in got.values()) and len(got) == len(rows)
        again = Counter(lines(calls)) - first
        failed = {t for t in first if again[t]}
        assert "bad/bad" in failed and len(failed) <= 8 and max(again.values()) == 1  # only the failed call's contents are tried again
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_waits_come_from_refusals(spark, tmp_path):
    slept = str(tmp_path / "slept")

    def make():
        tries = Counter()

        def ask(prompt):
            tries[prompt] += 1
            if prompt == "long":
                raise RuntimeError("Please try again in 6m26.208s.")
            if tries[prompt] < 3 and prompt in ("short", "silent"):
                raise RuntimeError("Please try again in 13.4s" if prompt == "short" else "connection lost")
            return f"{prompt} {tries[prompt]}"

        return ask

    df = spark.createDataFrame([(1, "long"), (2, "short"), (3, "silent"), (4, "fine")], "id int, prompt string").coalesce(1)
    got = {r["id"]: (r["reply"], r["error"]) for r in models.call(df, "id", "prompt", make, sleep=noted(slept)).collect()}
    assert got == {1: (None, "asked to wait 386.208 s: RuntimeError: Please try again in 6m26.208s."), 2: ("short 3", None), 3: ("silent 3", None), 4: ("fine 1", None)}
    assert lines(slept) == ["15.4", "15.4", "2.0", "8.0"]
    assert [models.wait_of(RuntimeError(x)) for x in ("try again in 5s", "Try Again In 1m0.5s", "later", "try again in 500ms")] == [5.0, 60.5, None, None]


def test_a_limit_a_minute_is_shared_by_all_partitions(spark, tmp_path):
    slept = str(tmp_path / "slept")
    df = spark.createDataFrame([(k, "p") for k in range(40)], "id int, prompt string")
    models.call(df, "id", "prompt", lambda: lambda p: p, workers=4, per_minute=60.0, sleep=noted(slept), clock=lambda: 0.0).collect()
    waits = [float(x) for x in lines(slept)]
    assert 32 <= len(waits) <= 39 and min(waits) >= 4.0  # four partitions, a call every four seconds in each
    pace, log, now = None, [], [0.0]
    pace = models.Pace(2.0, log.append, lambda: now[0])
    pace()
    now[0] = 0.5
    pace()
    now[0] = 9.0
    pace()
    assert log == [1.5]


def test_rerank_takes_the_remote_model_and_falls_back(spark):
    def remote():
        def ask(query, documents):
            if query == "down":
                raise ConnectionError("gateway")
            return [(i, len(d) / 10) for i, d in reversed(list(enumerate(documents))) if d != "left out"]

        return ask

    def local():
        def ask(query, documents):
            if any(d == "broken" for d in documents):
                raise ValueError("model")
            return [0.5] * len(documents)

        return ask

    rows = [(1, "q", k, "x" * (k % 7)) for k in range(150)] + [(2, "down", 1, "a"), (2, "down", 2, None), (3, "down", 1, "broken"), (4, None, 1, "left out"), (4, None, 2, "yes")]
    df = spark.createDataFrame(rows, "query_id long, query string, doc_id long, document string").repartition(3)
    got = {(r["query_id"], r["doc_id"]): (r["score"], r["step"], r["error"]) for r in models.rerank(df, remote, local, most=32).collect()}
    assert len(got) == len(rows) and all(got[1, k] == ((k % 7) / 10, "remote", None) for k in range(150))
    assert got[2, 1] == got[2, 2] == (0.5, "local", "ConnectionError: gateway") and got[3, 1] == (None, None, "ValueError: model")
    assert got[4, 1][:2] == (0.0, "remote") and got[4, 2][0] == 0.3
    assert {r["step"] for r in models.rerank(df.filter("query_id = 1"), None, local).collect()} == {"local"}


def test_false_merges_are_repaired_as_in_one_pass(spark):
    rng = random.Random(6)
    members = [(rng.randrange(12), k, f"title {k}", "text", f"2026-01-{rng.randrange(1, 20):02d}") for k in range(80)] + [(None, 900, "t", "x", "2026-01-01"), (50, 901, "single", "x", "2026-01-01")]
    written = [(t, 1000 + 10 * t + n, "w", "w", f"2026-02-{n + 1:02d}", [k for u, k, *_ in members if u == t][:3]) for t in range(8) for n in range(2)]
    said = {(a, b): rng.random() < 0.6 for a in [m[1] for m in members] for b in [*(m[1] for m in members), *(w[1] for w in written)]}
    silent = {k for k in said if rng.random() < 0.1}
    answers = spark.createDataFrame([(a, b, None if (a, b) in silent else s) for (a, b), s in said.items()], "id long, other long, same boolean").cache()
    asked = lambda pairs: pairs.join(answers, ["id", "other"]).select("id", "other", "same")
    done = state.repair_false_merges(spark.createDataFrame(members, "topic_id long, id long, title string, content string, published_at string"), spark.createDataFrame(written, "topic_id long, id long, title string, content string, created_at string, source_ids array<long>"), asked, F.col("id") + 5000)
    topic, reset, sources = {m[1]: m[0] for m in members}, {}, {w[1]: w[5] for w in written}
    yes = lambda a, b: (a, b) not in silent and said[a, b]
    for t in range(12):
        own = sorted((m for m in members if m[0] == t), key=lambda m: (m[4], m[1]))
        if len(own) < 2:
            continue
        newest = max((w for w in written if w[0] == t), key=lambda w: (w[4], w[1]), default=None)
        anchor = next((m for m in own if newest and yes(m[1], newest[1])), own[0])
        out = [m for m in own if m is not anchor and (m[1], anchor[1]) not in silent and not said[m[1], anchor[1]]]
        for m in out:
            topic[m[1]] = m[1] + 5000
        if out:
            reset[t] = anchor[2]
            for w in written:
                if w[0] == t:
                    left = [k for k in w[5] if topic[k] == t]
                    sources[w[1]] = left or w[5]
    assert {r["id"]: r["topic_id"] for r in done.articles.collect()} == topic
    assert {r["topic_id"]: r["representative_title"] for r in done.topics.collect()} == reset and len(reset) > 5
    assert {r["id"]: r["source_ids"] for r in done.generated.collect()} == sources
    assert {r["id"]: (r["topic_id"], r["title"]) for r in done.evicted.collect()} == {k: (t, f"title {k}") for k, t in topic.items() if t == k + 5000}


def test_calls_of_a_reranker_share_batches_and_stay_whole(spark):
    """Many small queries go to Python together; a call's candidates stay together over the edges of Arrow batches."""
    rows = [(q, str(q), d, "x") for q in range(40) for d in range(q % 11 + 1)] + [(None, "n", d, "x") for d in range(5)]
    df = spark.createDataFrame(rows, "query_id long, query string, doc_id long, document string").repartition(3)
    sized = lambda: lambda query, documents: [(k, len(documents)) for k in range(len(documents))]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        made = models.rerank(df, sized, sized)
        got = [(r["query_id"], r["score"]) for r in made.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(got, key=str) == sorted([(q, float(q % 11 + 1)) for q, _, _, _ in rows if q is not None], key=str)
    assert "FlatMapGroups" not in made._jdf.queryExecution().toString()
    assert models.rerank(df.limit(0), sized, sized).count() == 0
