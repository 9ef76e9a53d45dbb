"""Streams over many days: state that stays flat, rows kept whole, assignments that survive a restart."""

import datetime as dt
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from topicflow.operators import cluster, similarity
from topicflow.streaming import assign, ingest

EVENTS = "ts timestamp, event_type string, value double, id long"


def days_of(spark, folder, days, per_day=20, seed=1):
    """A file a day: events of five types, in order of days."""
    rng, every = random.Random(seed), []
    for d in range(days):
        rows = [(dt.datetime(2026, 1, 1) + dt.timedelta(days=d, seconds=rng.randrange(86400)), f"t{rng.randrange(5)}", float(rng.randrange(9)), d * per_day + k) for k in range(per_day)]
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/day={d:03d}")
        every += rows
    return every


def one_file_a_batch(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def run(query):
    query.awaitTermination(300)
    assert query.exception() is None
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_state_of_aggregates_stays_flat_and_rows_are_whole(spark, tmp_path):
    every = days_of(spark, str(tmp_path / "in"), 16)
    for name, make, key in (("daily", lambda e: ingest.daily_counts(e, "event_type", late="2 days"), "1 day"), ("hourly", lambda e: ingest.hourly_latest(e, "event_type", "id"), "1 hour")):
        counts = make(one_file_a_batch(spark, EVENTS, str(tmp_path / "in")))
        state = run(ingest.keep_changes(counts, str(tmp_path / name / "rows"), str(tmp_path / name / "ck")))
        assert len(state) >= 16 and max(state[8:]) <= max(state[:8]) + 5, (name, state)
        got = ingest.last_changes(spark, str(tmp_path / name / "rows"), ["window", "event_type"], counts)
        cut = (lambda t: t.replace(hour=0, minute=0, second=0)) if key == "1 day" else (lambda t: t.replace(minute=0, second=0))
        if name == "daily":
            assert {(r["window"]["start"], r["event_type"]): r["n"] for r in got.collect()} == Counter((cut(t), e) for t, e, _, _ in every)
        else:
            want = {}
            for t, e, _, i in sorted(every, key=lambda x: (x[0], x[3])):
                want[cut(t), e] = i
            assert {(r["window"]["start"], r["event_type"]): r["id"] for r in got.collect()} == want


def test_keys_leave_the_state_and_the_pool_keeps_each_once(spark, tmp_path):
    schema = "url string, content string, published_at timestamp, arrived_at timestamp"
    for d in range(14):
        day = dt.datetime(2026, 1, 1) + dt.timedelta(days=d)
        rows = [(f"http://x/{d}/{k}", "y" * 300, dt.datetime(2020, 1, 1) if k == 0 else day, day) for k in range(10)]
        rows += [("http://x/0/1/", "y" * 300, day, day), (f"http://X/{d}/2", "y" * 300, day, day)]  # repeats from long ago and of the day
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"day={d:03d}"))
    stream = one_file_a_batch(spark, schema, str(tmp_path / "in"))
    state = run(ingest.start(stream, str(tmp_path / "pool"), str(tmp_path / "ck"), "2026-01-15", within="12 hours"))
    assert max(state[7:]) <= max(state[:7]) + 3 and max(state) < 100, state
    pool = spark.read.parquet(str(tmp_path / "pool"))
    keys = [r["dedupe_key"] for r in pool.collect()]
    assert len(keys) == len(set(keys)) == 140
    assert pool.filter("gate.status = 'excluded'").count() == 14  # old rows are marked, not dropped
    assert pool.filter(F.col("bucket") != ingest.bucket("dedupe_key", 64)).count() == 0


def vectors(n, buckets, dim=6, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(buckets, 4, dim))
    out = []
    for i in range(n):
        b = int(rng.integers(buckets))
        v = centres[b, rng.integers(4)] + rng.normal(size=dim) * 0.8
        out.append((b, i, (v / np.linalg.norm(v)).tolist()))
    return out


def batch_topics(spark, rows, threshold):
    """The same by the batch operator, a bucket at a time."""
    want = {}
    for b in {r[0] for r in rows}:
        v = spark.createDataFrame([r[1:] for r in rows if r[0] == b], "id long, vector array<double>")
        want |= {r["id"]: r["topic"] for r in cluster.incremental(v, similarity.pairs_above(v, threshold, 5), threshold).collect()}
    return want


def test_three_batches_and_a_restart_give_the_batch_operator_s_topics(spark, tmp_path):
    schema = "bucket int, id long, vector array<double>"
    rows = vectors(240, 2)
    before = spark.conf.get(assign.PROVIDER)
    for name, stops in (("whole", [3]), ("stopped", [1, 2, 3])):
        folder, out, ck = (str(tmp_path / name / x) for x in ("in", "out", "ck"))
        done = 0
        for stop in stops:
            for k in range(done, stop):
                spark.createDataFrame([*rows[80 * k : 80 * k + 80], (None, 999, [1.0] * 6), (0, None, [1.0] * 6), (0, 998, None), rows[0]], schema).coalesce(1).write.parquet(f"{folder}/part={k}")
            done = stop
            q = assign.start(one_file_a_batch(spark, schema, folder), out, ck, 0.9)
            q.awaitTermination(300)
            assert q.exception() is None
        got = {r["id"]: r["topic"] for r in assign.topics(spark, out).collect()}
        if name == "whole":
            want = got
            assert got == batch_topics(spark, rows, 0.9) and 10 < len(set(got.values())) < 200
            assert spark.read.parquet(out).filter("id <> step").count() > 0  # topics did merge
        assert got == want
    assert spark.conf.get(assign.PROVIDER) == before
    assert assign.topics(spark, str(tmp_path / "nothing")).count() == 0
