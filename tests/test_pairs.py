"""Pairs of vectors by tiles: the same as a plain pass, on odd vectors too, and counted without a row a pair."""

import math
import random
from collections import Counter

import __spark_entry__ as entry
import numpy as np
import pytest
from conftest import SF
from topicflow.operators import similarity


def vectors(spark):
    rnd = random.Random(4)
    rows = [(k, [rnd.choice([-0.5, 0.0, 0.25, 0.7]) for _ in range(5)], rnd.choice([None, 1, 2])) for k in range(150)]
    rows += [(150, [math.inf, 0.0, 1.0, 0.0, 0.0], 1), (151, [math.nan] * 5, 2), (152, None, 1), (153, [1e30, 1.0, -1e30, 0.0, 2.0], 2), (154, [0.0] * 5, 1), (155, [1e30, 0.0, 1e30, 0.0, 0.0], 1)]
    return rows, spark.createDataFrame(rows, "id long, vector array<float>, kind long").repartition(5)


def plain(rows, least):
    for a, x, p in rows:
        for b, y, q in rows:
            if b < a and x is not None and y is not None:
                s = sum(u * v for u, v in zip(x, y))
                if s >= least and math.isinf(s) or round(s, 9) >= least:
                    yield a, b, s, p is not None and p == q


@pytest.mark.parametrize("block", [None, 40])
@pytest.mark.parametrize("k", [None, 2])
def test_pairs_of_odd_vectors(spark, block, k):
    rows, df = vectors(spark)
    short = spark.createDataFrame(df.collect(), df.schema)
    exact = [(r["id"], None if r["vector"] is None else list(r["vector"]), r["kind"]) for r in short.collect()]
    want = list(plain(exact, 0.5))
    if k:
        per = {}
        for a, b, s, same in sorted(want, key=lambda p: (p[0], -p[2], p[1])):
            per.setdefault(a, []).append((a, b, s, same))
        want = [p for ps in per.values() for p in ps[:k]]
    got = {(r["id"], r["near"], r["same"]): r["score"] for r in similarity.pairs_above(df, 0.5, k, block).collect()}
    assert got.keys() == {(a, b, same) for a, b, _, same in want} and len(got) == len(want) > 50
    assert all(got[a, b, same] == pytest.approx(s, rel=1e-6) for a, b, s, same in want)


@pytest.mark.parametrize("block", [None, 40])
def test_counts_of_pairs_by_kind_and_limit(spark, block):
    rows, df = vectors(spark)
    limits = [0.125, 0.25, 0.49]  # scores equal to limits occur
    exact = [(r["id"], None if r["vector"] is None else list(r["vector"]), r["kind"]) for r in df.collect()]
    kind = {a: p for a, _, p in exact}
    want = Counter((kind[a], kind[b], max(x for x in limits if x <= max(round(s, 9), x if math.isinf(s) else s))) for a, b, s, _ in plain(exact, limits[0]))
    got = {(r["kind"], r["near_kind"], r["score"]): r["n"] for r in similarity.pair_counts(df, limits, block).collect()}
    assert got == want


def test_best_pairs_leave_a_task_once_for_several_blocks(spark, monkeypatch):
    """Rows that leave the tasks grow with the vectors and sets of blocks, not with the blocks; they were 5 a block."""
    rnd = np.random.default_rng(5)
    v = rnd.normal(size=(600, 8)).astype(np.float32)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vector array<float>")
    left, best = [], similarity.top_n
    monkeypatch.setattr(similarity, "top_n", lambda found, *rest: left.append(found) or best(found, *rest))
    got = {(r["id"], r["near"]) for r in similarity.pairs_above(df, -99.0, 5, 50).collect()}
    score = np.round(v.astype(np.float64) @ v.T.astype(np.float64), 9)
    assert got == {(a, b) for a in range(600) for b in sorted(range(a), key=lambda b: (-score[a, b], b))[:5]}
    assert 0 < left[0].count() <= 600 * 5 * 3  # twelve blocks, four a task


def test_statistics_of_clusters_make_their_pairs_once(spark, monkeypatch):
    made, made_of = spark.sparkContext.accumulator(0), similarity.pairs_above

    def counted(*args):
        def seen(parts):
            for part in parts:
                made.add(len(part))
                yield part

        return made_of(*args).mapInPandas(seen, "id long, near long, score double")

    monkeypatch.setattr(similarity, "pairs_above", counted)
    got = entry.queries()["cluster_statistics"](spark, SF).collect()
    once = made.value
    v = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector")
    assert once == made_of(v, 0.35, 5).count() > 0 and len(got) == 1
