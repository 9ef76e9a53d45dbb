"""Words hashed to signed places, whatever the text."""

import hashlib

from topicflow.functions import text


def test_word_vectors_of_odd_texts(spark):
    rows = ["a  b\tA\nc", " lead", "", None, "ÄÖ äö", "word " * 500, "x" * 3000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "id int, t string")
    got = {r["id"]: r["v"] for r in df.select("id", text.bag_vector(df["t"], 8, 2000).alias("v")).collect()}
    for k, t in enumerate(rows):
        want = [0] * 8
        for w in (t or "")[:2000].lower().split():
            h = int(hashlib.md5(w.encode()).hexdigest()[:4], 16)
            want[(h >> 1) % 8] += 1 - 2 * (h % 2)
        size = sum(x * x for x in want) ** 0.5
        assert [round(x, 9) for x in got[k]] == [round(x / size, 9) if size else 0.0 for x in want], k
