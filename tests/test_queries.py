"""Every registered query runs on the small tables; those with SQL give the SQL's rows."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from roadtrace.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].map(lambda x: isinstance(x, list) or getattr(x, "ndim", 0) > 0).any():
            df[c] = df[c].map(lambda x: str(list(x)))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, D).toPandas()
    if name in ORACLES:
        want = con.sql(ORACLES[name]).df()
        pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False, rtol=1e-9, atol=1e-9)
    else:
        assert list(got.columns)


def test_entry_survives_without_the_training_data_operators(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_replay_rounds_speeds_as_the_sql_where_they_are_no_whole_cents(spark, tmp_path):
    c = duckdb.connect()
    c.execute(f"COPY (SELECT * REPLACE (value + event_id % 6 * 0.01::DOUBLE AS value) FROM '{D}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert c.sql("SELECT count(*) FROM events WHERE round(value, 1) <> CAST(round(CAST(CAST(value AS VARCHAR) AS DECIMAL(38, 20)), 1) AS DOUBLE)").fetchall()[0][0] > 0
    want, got = c.sql(ORACLES["s13_export_replay"]).df(), QUERIES["s13_export_replay"](spark, str(tmp_path)).toPandas()
    pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False, rtol=1e-9, atol=1e-9)
