"""The pipeline's near-duplicate stage against brute-force similarity of all pairs."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
from topicflow.llm import nearcopies
from topicflow.llm.common import table

SF = "/root/testdata/sf0.001"


def plain_groups(rows):
    """Root of each row: linked by Jaccard similarity 4/5 of sets of five-word shingles."""
    words = [(t or "").encode().lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if words[i] == words[j] or (both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def copies():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    line = [word() for _ in range(30)]  # in many texts that are no copies
    rows = []
    for k in range(24):
        base = [word() for _ in range(200)]
        if k % 2:
            base[20:50] = line
        for n in range(6):  # one to eight words changed: similarities about 0.67 to 0.95
            text = base.copy()
            for i in rnd.sample(range(200), n + k % 4):
                text[i] = word()
            rows.append((1000 * k + n, " ".join(text)))
    return rows + [(90_001, "one two three"), (90_002, "One  TWO three"), (90_003, "one two four"), (90_004, None), (90_005, "  ")]


def kept_of(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return corpus_pipeline.one_of_each(spark, df, SF)


def test_near_copies_are_those_of_brute_force(spark):
    rows = copies() + [(100_000 + r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    least = {}
    for (d, _), g in zip(rows, plain_groups(rows)):
        least[g] = min(d, least.get(g, d))
    assert 24 < sum(d < 90_000 for d in least.values()) < 144
    assert Counter(r["doc_id"] for r in kept_of(spark, rows).collect()) == Counter(least.values())


def test_radius_reaches_the_similarity():
    """Of pairs just at similarity 4/5, next to all are within the radius; of unrelated ones, none."""
    rng = np.random.default_rng(3)
    fresh = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    pairs, met, far = 0, 0, 0
    for n in [*range(4, 80), 200, 500] * 12:
        both = fresh(n)
        new = 2 * n // 8  # shared / (shared + new) is 4/5 or more
        k = int(rng.integers(0, new + 1))
        x, y = np.concatenate([both, fresh(k)]), np.concatenate([both, fresh(new - k)])
        if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
            continue
        a, b, c = ({"n": np.array([len(s)])} | {f"f{i}": f[None] for i, f in enumerate(nearcopies.wide_print(np.unique(s)))} for s in (x, y, fresh(len(x))))
        pairs += 1
        met += any(True for _ in nearcopies.proposed(a, b))
        far += any(True for _ in nearcopies.proposed(a, c)) and n > 8
    assert pairs > 800 and met >= 0.995 * pairs and far == 0


def test_rows_are_picked_by_bitmaps_or_by_a_join(spark):
    df = spark.range(100_000).selectExpr("id * 3 as nth", "cast(id as string) as text")
    wanted = df.filter("nth % 7 = 0").select("nth")
    got = [sorted(r["nth"] for r in nearcopies._only(df, wanted, most).collect()) for most in (1 << 25, 0)]
    assert got[0] == got[1] == [n for n in range(0, 300_000, 3) if n % 7 == 0]


def test_crowds_near_the_threshold(spark):
    """Copies with one word changed each: linked through their base, not to each other; without the base, apart."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows = []
    for g, n in ((0, 70), (1, 70)):
        base = [word() for _ in range(64)]
        for k in range(n):
            text = base.copy()
            text[rnd.randrange(5, 59)] = word()
            rows.append((1000 * g + k + 1, " ".join(text)))
        if g == 0:
            rows.append((1000 * g + 500, " ".join(base)))
    least = {}
    for (d, _), g in zip(rows, plain_groups(rows)):
        least[g] = min(d, least.get(g, d))
    assert sum(d < 1000 for d in least.values()) == 1 and sum(d >= 1000 for d in least.values()) > 1
    assert Counter(r["doc_id"] for r in kept_of(spark, rows).collect()) == Counter(least.values())
