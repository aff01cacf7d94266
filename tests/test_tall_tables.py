"""Queries over tables with more rows than a sheet, against their SQL."""

import pytest

from tabloom import plans

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def tall(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tall"))
    for table, key, n in (("lineitem", "l_orderkey", 1_050_000), ("part", "p_partkey", 60_000)):
        duckdb.sql(f"COPY (SELECT range AS {key} FROM range({n})) TO '{d}/{table}.parquet'")
    return d


@pytest.mark.parametrize("name", ["r1c1_blocks", "extruded_edges", "block_inconsistency", "self_inclusion"])
def test_tall_table_equals_sql(spark, tall, name):
    con = duckdb.connect()
    for table in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tall}/{table}.parquet'")
    got = plans.QUERIES[name](spark, tall)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({plans.ORACLES[name]})").fetchall()
    have = [tuple(r) for r in got.select(*cols).collect()]
    assert len(have) == len(want) and set(have) == set(want)
