"""Every registered query of the log engine against its SQL."""

import glob
import os

import pandas as pd
import pytest

from tidelog.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def tidy(df, columns):
    one = lambda v: None if pd.isna(v) else round(v, 6) if isinstance(v, float) and v != int(v) else int(v) if isinstance(v, float) else v
    return sorted((tuple(str(one(v)) for v in r) for r in df[columns].astype(object).itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = duck.sql(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert tidy(got, columns) == tidy(want, columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_stream_takes_all_events(spark, tmp_path, monkeypatch):
    from tidelog.plans import catalog
    from tidelog.sources.store import LogStore

    monkeypatch.setattr(catalog, "_work_folder", lambda spark, label: str(tmp_path / label))
    QUERIES["stream_append_replay"](spark, "/root/testdata/sf0.01")
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").count()
    assert events > 2000 and LogStore(spark, str(tmp_path / "stream" / "store")).read().count() == events
