"""What the near-duplicate stage sends and leaves on disk."""

import glob
import random

import corpus_pipeline
from test_nearcopies import SF, copies, kept_of, plain_groups
from topicflow.llm import nearcopies


def word(rnd):
    return "".join(rnd.choice("abcdefghij") for _ in range(6))


def half_copies(pairs):
    """Pairs of texts of similarity 0.7, near enough to be proposed, too far to be linked, of many sizes."""
    rnd, rows = random.Random(5), []
    for k in range(pairs):
        base = [word(rnd) for _ in range(100 + 2 * k)]
        for n in range(2):
            text = base.copy()
            for at in range(5, len(base) - 5, 42 if n else 10**9):
                text[at] = word(rnd)
            rows.append((2 * k + n, " ".join(text)))
        rows[-1] = (2 * k + 1, rows[-1][1] + " " + " ".join(word(rnd) for _ in range(len(base) // 8)))
    return rows


def written_mb(spark, since):
    stages = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))
    return sum(s.shuffleWriteBytes() for s in stages if s.stageId() >= since) / 1e6, 1 + max((s.stageId() for s in stages), default=-1)


def test_sets_are_sent_about_once(spark):
    """They went to every tile of near sizes three times over."""
    rows = half_copies(150)
    sets = sum(8 * (len(t.split()) - 4) for _, t in rows) / 1e6
    assert len(set(plain_groups(rows))) == len(rows)
    since = written_mb(spark, 0)[1]
    key = "spark.sql.autoBroadcastJoinThreshold"
    small = spark.conf.get(key)
    spark.conf.set(key, -1)  # as for larger tables
    try:
        assert kept_of(spark, rows).count() == len(rows)
    finally:
        spark.conf.set(key, small)
    texts = sum(len(t) for _, t in rows) / 1e6  # dealt to partitions by the test itself
    sent = written_mb(spark, since)[0] - texts
    assert sets / 2 < sent < 2 * sets, (sent, sets, texts)  # many are proposed


def test_only_what_the_result_reads_stays_on_disk(spark):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = set(glob.glob(f"{folder}/topicflow-*"))
    out = kept_of(spark, copies())
    left = set(glob.glob(f"{folder}/topicflow-*")) - before
    assert len(left) <= 3, left  # the rows, those wanted, their bitmaps
    assert out.count() > 0


def test_pipeline_leaves_one_stage_on_disk(spark):
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = set(glob.glob(f"{folder}/topicflow-*"))
    out = corpus_pipeline.run(spark, SF)
    assert len(set(glob.glob(f"{folder}/topicflow-*")) - before) == 1
    assert out.count() > 0


def test_crowds_and_groups_and_many_tiles_give_the_same(spark, monkeypatch):
    rows = copies()
    roots = plain_groups(rows)
    want = {min(d for (d, _), g in zip(rows, roots) if g == r) for r in set(roots)}
    for group_rows, least in ((1024, 8192), (1, 16)):
        monkeypatch.setattr(nearcopies.links, "__defaults__", (least, group_rows))
        assert {r["doc_id"] for r in kept_of(spark, rows).collect()} == want
