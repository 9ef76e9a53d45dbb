"""The pipeline's stages, each on its own input, and its queries' registration."""

import corpus_pipeline
import __spark_entry__ as entry
import pytest
from oracle import both
from test_nearcopies import plain_groups
from topicflow.llm import decontam
from topicflow.llm import queries as llm_queries
from topicflow.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before, after = ({r["doc_id"] for r in x.select("doc_id").collect()} for x in (docs, out))
        assert after <= before
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
            least = {}
            for (d, _), g in zip(rows, plain_groups(rows)):
                least[g] = min(d, least.get(g, d))
            assert after == set(least.values())
        elif name == "decontamination":
            assert before - after == {r["doc_id"] for r in decontam.contaminated(docs, table(spark, SF, "benchmark")).collect()}
        elif name in ("secrets", "packing"):
            assert before == after
        docs = out


def test_registered():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(llm_queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    columns, theirs, mine, want = both(spark, entry, name, SF)
    assert columns == theirs
    assert mine and mine == want


def test_shards_sql_with_nulls_ties_and_repeats(spark):
    import duckdb
    import pyarrow as pa

    rows = [(None, "x"), (3, "ü" * 50), (3, None), (3, "ü" * 50), (1, ""), (2, "long " * 900), (None, None)]
    documents = pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string())})  # noqa: F841  read by name below
    want = duckdb.sql(llm_queries.SHARDS).fetchall()
    from topicflow.llm import sharding

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in sharding.shard_by_bytes(df).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
