"""Many copies of one row in the suffix operator: time goes with the rows."""

import hashlib
import time

from topicflow.llm import suffix


def test_copies_of_one_row_cost_no_more_than_their_number(spark):
    line = "the same line again and again. "
    texts = [line * 80, "".join(f"{k} is a number and {k * k} its square; " for k in range(80)), "".join(f"{k} stands alone, " for k in range(400, 440))]
    took = []
    for n in (1000, 10_000):
        rows = [(7, texts[0])] * n + [(None, texts[1])] * n + [(8, texts[2])] + [(9, texts[0])]
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as th", "text as found", "1 as start")  # clashing names beside
        began = time.perf_counter()
        got = suffix.dedup(df).groupBy("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").count().collect()
        took.append(time.perf_counter() - began)
        empty = hashlib.sha256(b"").hexdigest()
        alone = len(texts[2])
        assert {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["count"]) for r in got} == {
            (7, 2480, 2480, 1, empty, n), (9, 2480, 2480, 1, empty, 1), (None, len(texts[1]), len(texts[1]), 1, empty, n), (8, alone, 0, 0, hashlib.sha256(texts[2].encode()).hexdigest(), 1),
        }
    assert took[1] < 10 * took[0], took
