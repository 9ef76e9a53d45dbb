"""Graph queries where parts' numbers reach those of suppliers, which are moved by a million."""

import __spark_entry__ as entry
import duckdb
import pytest
from conftest import SF
from oracle import both


@pytest.mark.parametrize("name", ["graph_core_subgraph", "graph_label_counts", "graph_degree_top25", "graph_two_hop"])
def test_pairs_stay_as_written(spark, tmp_path, name):
    folder = str(tmp_path)
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        (tmp_path / f"{table}.parquet").symlink_to(f"{SF}/{table}.parquet")
    shifted = f"SELECT * REPLACE (l_partkey + CASE WHEN l_partkey % 2 = 0 THEN 1000000 ELSE 0 END AS l_partkey) FROM '{SF}/lineitem.parquet'"
    duckdb.sql(f"COPY ({shifted}) TO '{folder}/lineitem.parquet'")
    _, _, mine, want = both(spark, entry, name, folder)
    assert mine == want and mine
