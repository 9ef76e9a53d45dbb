"""Further columns, named as an operator's own, change nothing."""

import pytest
from topicflow.llm import ctw, licenses, simhash, suffix, tokencount

NAMES = ["fp", "node", "root", "least", "n_tokens", "held_out", "score", "th", "start", "spans", "n_words", "h", "f", "mark", "key", "word", "n"]


@pytest.mark.parametrize("operator", [ctw.score, simhash.near_duplicates, suffix.dedup, licenses.report], ids=["op2", "op9", "op10", "op12"])
def test_clashing_columns(spark, operator):
    long = " ".join(f"word{k}" for k in range(90))
    rows = [(1, "some words of a text"), (2, "some words of a text"), (3, None), (None, "mit license and no id"), (5, long + " its end"), (6, "its start " + long), (7, ""), (7, "")]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    wide = spark.createDataFrame([(*r, *[f"v{k}" for k in range(len(NAMES))]) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in NAMES))
    show = lambda df: sorted(map(str, df.collect()))
    want = show(operator(plain))
    assert len(want) == len(rows) and show(operator(wide)) == want


def test_token_counts_of_clashing_columns(spark):
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    plain = spark.createDataFrame([(1, "some words"), (None, None)], "doc_id long, text string")
    wide = plain.selectExpr("*", "'x' as n_tokens", "1.5 as best_score")
    assert sorted(map(str, tokencount.count_tokens(wide, model).collect())) == sorted(map(str, tokencount.count_tokens(plain, model).collect()))
