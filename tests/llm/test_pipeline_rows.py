"""Stages 2 and 3 decide on each row, whatever its doc_id."""

from collections import Counter

import corpus_pipeline

WORDS = [f"w{k}" for k in range(60)]
LEAK = " ".join(f"item{k}" for k in range(25))


def left(stage, spark, rows, sf_dir=""):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    out = stage(spark, df, sf_dir)
    assert out.columns == df.columns
    return Counter(tuple(r)[:2] for r in out.collect())


def test_near_duplicates_of_null_and_repeated_ids(spark):
    a, b, c = " ".join(WORDS), " ".join(WORDS[:59]), "a text of its own that nothing is like"
    rows = [(5, a, "x"), (5, a, "x"), (5, b, "y"), (None, a, "x"), (9, b, "x"), (9, c, "x"), (None, "only here", "x"), (None, "only here", "x")]
    got = left(corpus_pipeline.one_of_each, spark, rows)
    assert got - Counter({(5, a): 1, (5, b): 1}) == Counter({(9, c): 1, (None, "only here"): 1}) and sum(got.values()) == 3


def test_contaminated_rows_of_null_and_repeated_ids(spark, tmp_path):
    spark.createDataFrame([(1, LEAK), (2, " ".join(WORDS))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, f"before {LEAK} after", "x"), (4, f"{LEAK} after", "x"), (4, "clean text", "x"), (None, "clean too", "x"), (6, None, "x"), (7, " ".join(WORDS[:58]), "x")]
    assert left(corpus_pipeline.drop_contaminated, spark, rows, str(tmp_path)) == Counter([(4, "clean text"), (None, "clean too"), (6, None)])
