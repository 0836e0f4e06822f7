"""Every registered query against its DuckDB oracle on the smallest scale factor
(the driver does the same at sf0.01)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

from check_oracle import TABLES, rows_key  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from chainlens.plans.registry import REGISTRY  # noqa: E402

SF = "/root/testdata/sf0.001"
SQL = {n: q.oracle() for n, q in REGISTRY.items()}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(SQL[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert rows_key(df.columns, rows) == rows_key(ocols, res.fetchall())


@pytest.mark.skipif(not os.path.exists(SF), reason="test data not present")
def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 507          # FIXTURES §3: low stock at sf0.001
    assert df.columns[0] == "inventory_id"


def test_every_query_has_an_oracle():
    assert all(SQL.values()) and set(SQL) <= set(E.oracle_sql()) and set(SQL) <= set(E.queries())
