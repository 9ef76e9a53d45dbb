"""Canonical names among vectors: the same as a plain pass, in a few turns, without a row a pair."""

import math
import os
import random

import __spark_entry__ as entry
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from topicflow.operators import cluster, resolution, similarity


def plain(rows, sure, low, most):
    """rows: (id, place, vector, kind)."""
    names = sorted({(p, a) for a, p, _, _ in rows if a is not None})
    of = {}
    for a, _, x, kind in rows:
        if x is not None:
            of.setdefault(a, []).append((np.array(x, np.float32).astype(float), kind))
    found = {}
    for _, a in names:
        canon = []
        for b in (b for b, c in found.items() if b == c):
            for x, p in of.get(a, []):
                for y, q in of.get(b, []):
                    with np.errstate(all="ignore"):
                        s = float(np.round(np.einsum("ij,ij->i", x[None], y[None]), 9)[0])
                    if not math.isnan(s) and s > -math.inf:
                        canon.append((s, str(b), p is not None and p == q))
        best = max(((s, b) for s, b, _ in canon if s >= sure), default=None)
        asked = sorted((-s, b, same) for s, b, same in canon if low is not None and low < s < sure)[:most]
        said = best[1] if best else next((b for _, b, same in asked if same), str(a))
        found[a] = a if said == str(a) else int(said)
    return {str(a): str(b) for a, b in found.items()}


def odd(n=220):
    rnd = random.Random(6)
    cells = [-0.5, 0.0, 0.25, 0.5]
    rows = [(k * 7 - 400, [rnd.choice(cells) for _ in range(5)], rnd.choice([None, 1, 2])) for k in range(n)]
    rows += [(k * 7 - 400, [rnd.choice(cells) for _ in range(5)], rnd.choice([1, 2])) for k in range(0, n, 9)]  # names with two vectors
    rows += [(5000, [math.inf, 0.0, 1.0, 0.0, 0.0], 1), (5001, [math.nan] * 5, 2), (5002, None, 1), (5003, [1e30, 1.0, -1e30, 0.0, 2.0], 2), (5004, [0.0] * 5, 1), (None, [0.5] * 5, 1)]
    return [(a, None if a is None else (a * 37) % 10007, x, kind) for a, x, kind in rows]


@pytest.mark.parametrize("sure, low", [(0.5, None), (0.625, 0.25), (0.75, 0.0)])
@pytest.mark.parametrize("turn, most_rows", [(8192, 32768), (24, 50)])
def test_canonical_vectors_like_one_pass(spark, sure, low, turn, most_rows):
    rows = odd()
    df = spark.createDataFrame(rows, "id long, place long, vector array<float>, kind int").repartition(3)
    got = resolution.canonical_vectors(df, sure, low, 3, turn, most_rows).collect()
    want = plain(rows, sure, low, 3)
    assert 20 < sum(a == b for a, b in want.items()) < 200
    assert {r["name"]: r["canonical"] for r in got} == want | {None: None} and len(got) == len(want) + 1


def test_canonical_vectors_of_nothing(spark):
    schema = "id long, place long, vector array<float>"
    assert resolution.canonical_vectors(spark.createDataFrame([], schema), 0.5).count() == 0
    only = spark.createDataFrame([(3, 3, None), (None, None, [1.0])], schema)
    assert {tuple(r) for r in resolution.canonical_vectors(only, 0.5).collect()} == {("3", "3"), (None, None)}


def test_queries_equal_resolution_over_all_pairs(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector", "label AS kind")
    p = similarity.pairs_above(v, 0.3).select(F.col("id").cast("string").alias("name"), F.col("near").cast("string").alias("other"), "score", "same")
    want = cluster.resolve(v.select(F.col("id").cast("string").alias("name")), p, 0.45, 0.3)
    assert {tuple(r) for r in entry.queries()["entity_resolution"](spark, SF).collect()} == {tuple(r) for r in want.collect()}
    tags = cluster.canonical_names(v.select(F.col("id").cast("string").alias("name"), (F.col("id") % 17).alias("n")), p.drop("same"), 0.3)
    assert {tuple(r) for r in entry.queries()["tag_clusters"](spark, SF).collect()} == {tuple(r) for r in tags.collect()}


def test_disk_does_not_grow_with_the_pairs(spark, tmp_path):
    """All vectors resemble each other: half a million pairs, one canonical name."""
    rng = np.random.default_rng(2)
    x = 1 + 0.1 * rng.normal(size=(1000, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    size = lambda: sum(os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(folder) for f in fs)
    for name in ("entity_resolution", "tag_clusters"):
        before = size()
        got = entry.queries()[name](spark, str(tmp_path))
        assert len({r["canonical"] for r in got.collect()}) == 1 and got.count() == 1000
        assert size() - before < 500_000  # the vectors have 64,000 bytes
