"""Empty tables, null and repeated ids and clashing columns, for every operator and every stage of the pipeline."""

import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from topicflow.llm import ctw, decontam, nearcopies, packing, secrets, sharding, simhash, suffix, tokencount, topk, toxicity
from topicflow.llm.common import materialize, shared_dir, table
from topicflow.llm.components import components

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t)) for d, t in rows], COLUMNS)


def test_empty_tables(spark):
    none, words = docs_of(spark, []), public_tokenizers.path("word_bpe_49k.json")
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    model = toxicity.Model({" bad ": 1.0}, frozenset(), 0.0, 1.0)
    results = [
        packing.pack(none, words), ctw.score(none), decontam.contaminated(none, bench), decontam.without_contaminated(none, bench), toxicity.score(none, model), toxicity.without_toxic(none, model), sharding.shard_by_bytes(none),
        secrets.report(none), secrets.redact(none), tokencount.count_tokens(none, public_tokenizers.path("piece_bpe_32k.model")), simhash.near_duplicates(none), suffix.dedup(none), suffix.cleaned(none),
        topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")), nearcopies.one_of_each(none.selectExpr("*", "0L as nth")), components(spark.createDataFrame([], "a long, b long")),
    ]
    assert [r.count() for r in results] == [0] * len(results)


def test_components_of_loops_nulls_and_long_chains(spark):
    edges = [(5, 5), (None, 3), (3, None), *[(k, k + 1) for k in range(100, 300)], (150, 101), (150, 101)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {5: 5} | {k: 100 for k in range(100, 301)}


def awkward(spark):
    """Null, repeated and shared ids; null and empty texts; copies, leaks, secrets and toxic words."""
    item = next(r["text"] for r in table(spark, SF, "benchmark").collect() if len(r["text"].split()) > 20)
    long = " ".join(f"w{k}" for k in range(300))
    return [
        (None, None), (None, ""), (1, long), (1, long), (2, long + " more"), (None, long), (3, "clean words of document three"), (3, f"its id is shared {item} with this leak"), (None, f"no id {item} leak"),
        (4, "password = hunter2hunter2"), (None, "token: abcdefgh12345"), (5, "clean words of document five"), (5, "clean words of document five"), (6, item),
    ]


def plain_near(rows):
    """First row by (null last, id) of each group of equal or 0.8-similar texts."""
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for _, t in rows]
    alike = lambda a, b: (not a and not b) or (a and b and 5 * len(a & b) >= 4 * len(a | b))
    left, out = list(range(len(rows))), []
    while left:
        group, grown = {left[0]}, True
        while grown:
            more = {k for k in left if any(alike(sets[k], sets[g]) for g in group)} - group
            group, grown = group | more, bool(more)
        out.append(min(((rows[k][0] is None, rows[k][0] or 0) for k in group)))
        left = [k for k in left if k not in group]
    return Counter(out)


def test_stages_decide_by_row(spark):
    rows = awkward(spark)
    docs = docs_of(spark, rows)
    back = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)
    model = toxicity.Model({" hunter2hunter2 ": 5.0, " bad ": 5.0}, frozenset(), -3.0, 2.0)
    kept = back(toxicity.without_toxic(docs, model))
    scored = Counter(r["doc_id"] for r in toxicity.score(docs, model).filter("predicted = 0").collect())
    assert Counter(d for (d, _), n in kept.items() for _ in range(n)) == scored and sum(kept.values()) < len(rows)
    near = back(stages["near_duplicates"](spark, docs, SF))
    assert Counter((d is None, d or 0) for (d, _), n in near.items() for _ in range(n)) == plain_near(rows)
    clean = back(stages["decontamination"](spark, docs, SF))
    leaks = {t for _, t in rows if t and "leak" in t} | {rows[-1][1]}
    assert clean == Counter({r: n for r, n in Counter(rows).items() if r[1] not in leaks})
    hidden = stages["secrets"](spark, docs, SF)
    assert hidden.columns == docs.columns and hidden.count() == len(rows)
    texts = Counter(r["text"] for r in hidden.collect())
    assert texts["[SECRET]"] == 2 and not any(re.search("hunter2|abcdefgh12345", t or "") for t in texts)
    packed = stages["packing"](spark, docs, SF).collect()
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == Counter(d for d, _ in rows)


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

            @staticmethod
            def getConf():  # noqa: N802
                return Conf()

    with pytest.raises(ValueError):
        shared_dir(Session())
    assert shared_dir(spark) and materialize(spark.range(3)).count() == 3
