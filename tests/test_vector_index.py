"""The vector index: recall, the share it reads, and its exact part against all pairs."""

import numpy as np
from topicflow.operators import cluster, similarity, vector_index

SCHEMA = "id long, vector array<double>"


def crowds(n, groups, dim=32, seed=1):
    """Unit vectors around ``groups`` directions, a third of them in one."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    group = np.where(np.arange(n) % 3 == 0, 0, rng.integers(0, groups, n))
    v = centres[group] + rng.normal(size=(n, dim)) * 0.35
    return [(int(i), (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(v)]


def pairs(df):
    return {(r["id"], r["near"]): r["score"] for r in df.collect()}


def test_recall_of_nine_in_ten_at_a_tenth_of_the_pairs(spark):
    v = spark.createDataFrame(crowds(3000, 40), SCHEMA).cache()
    index = vector_index.build(v, rows_per_slot=200)  # the crowded list is dealt to many slots
    probes = vector_index.tuned(index, v, 5)
    found = vector_index.search(index, v, 5, -2.0, probes).cache()
    exact = similarity.pairs_above(v, -2.0, 5).cache()
    got = vector_index.recall(exact, found).first()
    share = vector_index.probed_share(index, v, probes).first()["share"]
    assert got["recall"] >= 0.9 and share < 0.35, (got, share, probes)
    true = pairs(exact)
    assert all(abs(true[k] - s) < 1e-9 for k, s in pairs(found).items() if k in true)


def test_all_lists_probed_is_the_exact_answer(spark):
    rows = crowds(400, 5, dim=8)
    v = spark.createDataFrame([*rows, *[(1000 + k, rows[k][1]) for k in range(40)]], SCHEMA)
    index = vector_index.build(v, vector_index.fit(v, lists=7), rows_per_slot=50)
    assert pairs(vector_index.search(index, v, 5, 0.2, probes=7)) == pairs(similarity.pairs_above(v, 0.2, 5))
    one = v.filter("id in (17, 1003)")
    assert pairs(vector_index.exact_for(one, v, 3)) == {k: s for k, s in pairs(similarity.pairs_above(v, -2.0, 3)).items() if k[0] in (17, 1003)}
    both = pairs(vector_index.search(index, one, 500, 0.5, probes=7, earlier=False))
    assert (17, 1017) in both and all(a != b for a, b in both)


def test_topics_by_the_index_are_those_by_all_pairs(spark):
    v = spark.createDataFrame(crowds(600, 12, seed=4), SCHEMA)
    index = vector_index.build(v)
    topics = lambda candidates: {r["id"]: r["topic"] for r in cluster.incremental(v, candidates, 0.6).collect()}
    mine, exact = topics(vector_index.search(index, v, 5, 0.6, 16)), topics(similarity.pairs_above(v, 0.6, 5))
    assert sum(mine[i] == exact[i] for i in exact) > 0.97 * len(exact) and len(mine) == len(exact)


def test_null_odd_and_no_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (None, [1.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, 0.0])]
    v = spark.createDataFrame(rows, SCHEMA)
    got = pairs(vector_index.search(vector_index.build(v), v, 2, 0.5, 4))
    assert got == {(5, 1): 1.0}
    none = spark.createDataFrame([], SCHEMA)
    index = vector_index.build(none)
    assert vector_index.search(index, v, 2).count() == 0 and vector_index.search(vector_index.build(v), none, 2).count() == 0


def test_tuning_searches_once_and_finds_the_least_probes(spark, monkeypatch):
    v = spark.createDataFrame(crowds(1500, 20), SCHEMA).cache()
    index = vector_index.build(v, vector_index.fit(v, lists=12), rows_per_slot=100)
    asked = v.filter("id % 10 = 0")
    exact, search, calls = vector_index.exact_for(asked, v, 5), vector_index.search, []
    got = lambda probes: vector_index.recall(exact, search(index, asked, 5, probes=probes)).first()["recall"]
    monkeypatch.setattr(vector_index, "search", lambda *args: calls.append(args) or search(*args))
    probes = vector_index.tuned(index, v, 5, one_in=10)
    assert len(calls) == 1  # the exact answers
    grid = [1, 2, 3, 4, 6, 9, 12]
    assert probes in grid and got(probes) >= 0.95 and (probes == 1 or got(grid[grid.index(probes) - 1]) < 0.95)
