"""Top-k of vectors of every finite size, against Python's integers; a column's own name in the pipeline's stages."""

import math
import random

import corpus_pipeline
from topicflow.llm import topk

SF = "/root/testdata/sf0.001"


def plain(rows, k=20, scale=64):
    whole = lambda v: [int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in v]
    kept = [(i, whole(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(q, tuple(a)) for q, a in kept if q % 20 == 0}:
        scored = [(sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q and len(a) == len(b)]
        scored = sorted((-s, i) for s, i in scored if -(2**63) <= s < 2**63)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_every_finite_vector_takes_part(spark):
    rng = random.Random(5)
    sizes = [1, 1, 1, 1e3, 1e9, 1e12, 1e15, 2.0**24, 2.0**55, 1e30, 1e300]
    rows = [(k, [rng.gauss(0, rng.choice(sizes)) for _ in range(5)]) for k in range(120)]
    rows += [(20, [3.0, 1e9]), (1, [3.0, 1e9]), (2, [1.0, 1.0]), (40, [1.0, 1.0]), (3, [1e308, -1e308]), (60, [5e-324, 0.0]), (80, []), (81, [])]
    rows += [(400 + k, [0.001 * (k + 1), 0.5]) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for blocks in ({}, {"row_block": 40, "query_block": 4, "far_block": 16}):
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, **blocks).collect())
        assert got == plain(rows)
    assert any(x[0] == 40 and x[2] == 1 for x in got)


def test_only_far_vectors_or_none(spark):
    rows = [(20, [1e12, 1.0]), (1, [2.0**40, -7.5]), (2, [-1e10, 1e10])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(df).select("query_id", "rank", "vec_id", "score").collect()) == plain(rows)


def test_stages_keep_columns_of_any_name(spark):
    """Columns named as an operator's own come through every stage with their values."""
    names = ["nth", "node", "row", "rest", "spans_", "text_", "score", "least", "fp", "doc"]
    rows = [(1, "clean words of document one", *range(777, 787)), (2, "clean words of document one", *range(888, 898)), (3, "quite another text here", *range(999, 1009))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    want = {1: tuple(range(777, 787)), 3: tuple(range(999, 1009))}
    out = docs
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns, name
        assert {r["doc_id"]: tuple(r[n] for n in names) for r in out.collect()} == want, name
    bare = corpus_pipeline.STAGES[1][1](spark, docs.select("doc_id", "text"), SF)
    assert sorted(r["doc_id"] for r in bare.collect()) == [1, 3]
