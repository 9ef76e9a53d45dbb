"""Embeddings of whole texts, not of their beginnings."""

import duckdb
import __spark_entry__ as entry
from conftest import SF
from oracle import both, plain


def test_words_after_the_first_2000_characters_count(spark, tmp_path):
    rows = [(1, "same " * 500 + "end"), (2, "same " * 500 + "other"), (3, "x" * 5000 + " tail" * 3), (4, None), (5, "Ä  b\tA\n" * 900)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in entry.queries()["hashed_embedding"](spark, str(tmp_path)).select("id", "place", "x").collect()]
    of = {k: [x for d, _, x in sorted(got) if d == k] for k in range(1, 6)}
    assert of[1] != of[2] and any(of[3])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT id, place, x FROM ({entry.oracle_sql()['hashed_embedding']})").fetchall()
    key = lambda rows: sorted(tuple(map(plain, r)) for r in rows)
    assert key(got) == key(want)


def test_same_rows_as_sql(spark):
    columns, theirs, mine, want = both(spark, entry, "hashed_embedding", SF)
    assert columns == theirs and mine and mine == want
