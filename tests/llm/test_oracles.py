"""Exact operators against their SQL in DuckDB, on a supplied table and on awkward rows."""

import duckdb
import pytest

from wavesift.llm import queries

SQL = queries.oracle_sql()


def check(spark, folder, name, files):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet{files}'")
    want = con.sql(SQL[name])
    columns = sorted(want.columns)
    got = queries.queries()[name](spark, str(folder))
    assert sorted(got.columns) == columns
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want.select(*columns).fetchall(), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_supplied_table(spark, name):
    folder = "/root/testdata/sf0.001"
    check(spark, folder, name, "")


@pytest.mark.parametrize("name", sorted(SQL))
def test_awkward_rows(spark, docs, tmp_path, name):
    docs.where("doc_id is not null").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [[float((i * 37 + j * 11) % 29) / 7 - 2 for j in range(64)] for i in range(70)]
    vectors += [None, [], [1.0] * 63, [None, *[1.0] * 63], [float("nan")] * 64, [float("-inf"), *[0.0] * 63], [0.0] * 64, vectors[3], vectors[3]]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    check(spark, tmp_path, name, "/*.parquet")
