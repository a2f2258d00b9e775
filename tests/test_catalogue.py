"""Every registered query against the same query in DuckDB."""

import duckdb
import pytest

from wavesift.plans import catalogue, oracles

SF = "/root/testdata/sf0.001"
SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("events", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = db.sql(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (d[columns].sort_values(columns).reset_index(drop=True) for d in (got, want))
    assert len(got) == len(want)
    for c in columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


def test_series_beyond_full_scale_and_short_ones(spark, tmp_path):
    db = duckdb.connect()
    db.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, if(i < 420, 'long', 'short') AS event_type, (i * 2 - 300)::DOUBLE AS value
        FROM range(500) r(i)) TO '{tmp_path}/events.parquet'""")
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = {tuple(r) for r in catalogue.wav_samples(spark, str(tmp_path)).select("file", "n", "amplitude").collect()}
    want = set(db.sql(f"SELECT file, n, amplitude FROM ({SQL['wav_samples']})").fetchall())
    assert got == want and len(got) == 320 and max(a for _, _, a in got) > 1


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_without_sql(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
