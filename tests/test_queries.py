import glob
import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from tabloom import plans

duckdb = pytest.importorskip("duckdb")


def _plain(rows):
    def one(v):
        return round(float(v), 5) if isinstance(v, float) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for p in glob.glob(sf + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, sf, db, name):
    got = plans.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    want = db.execute(plans.ORACLES[name]).df()
    assert sorted(want.columns) == cols
    want = [tuple(None if pd.isna(x) else (x.item() if hasattr(x, "item") else x) for x in r) for r in want[cols].astype(object).itertuples(index=False, name=None)]
    have = [tuple(r) for r in got.select(*(f"`{c}`" for c in cols)).collect()]
    number = lambda rows: _plain([tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) if v is not None else None for v in r) for r in rows])
    assert number(have) == number(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
