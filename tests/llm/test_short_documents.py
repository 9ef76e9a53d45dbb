"""Documents shorter than the benchmark items they hold, against brute force."""

from collections import Counter

from topicflow.llm import decontam


def plain_short_leaks(docs, items, threshold=0.8):
    """Whole documents with fewer shingles than an item."""
    out = set()
    for item, text in items:
        w = (text or "").encode().lower().split()
        m = min(5, len(w))
        own = Counter(tuple(w[i : i + m]) for i in range(len(w) - m + 1)) if w else Counter()
        for d, t in docs:
            x = (t or "").encode().lower().split()
            mine = Counter(tuple(x[i : i + m]) for i in range(len(x) - m + 1)) if m else Counter()
            both, n = sum((mine & own).values()), sum(mine.values()) + sum(own.values())
            if sum(mine.values()) < sum(own.values()) and both and 2 * both / n >= threshold:
                out.add((d, item, round(2 * both / n, 9), 0, len(x)))
    return out


def test_shortened_items_are_found(spark):
    passage = [f"w{k}" for k in range(25)]
    words = lambda *parts: " ".join(w for p in parts for w in p)
    items = [(1, words(passage)), (2, words(passage[:12], passage[:12])), (3, "one two three four five six"), (4, words(passage[1:], ["x"])), (5, None), (5, "one two")]
    docs = [(None, words(passage[:23])), (100, words(passage[:23]))] + [(100 + k, words(passage[k:]).upper()) for k in range(1, 13)]
    docs += [(200 + k, words(passage[: 25 - k])) for k in range(1, 13)] + [(300, words(passage[:10], ["y"], passage[11:23])), (301, words(passage[:12], passage[:11])), (302, "one two three four five"), (303, "one two three four"), (304, None), (305, "one")]
    want = plain_short_leaks(docs, items)
    assert {(100, 1), (None, 1), (301, 2)} <= {x[:2] for x in want} and 302 not in {x[0] for x in want}
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    length = {item: len((t or "").split()) for item, t in items}
    for block in (1_000_000, 30):
        got = decontam.contaminated(rows, bench, block_words=block).collect()
        assert {(r["doc_id"], r["item_id"], round(r["similarity"], 9), r["word_start"], r["n_words"]) for r in got if r["n_words"] < length[r["item_id"]]} == want
