"""Compares a query with its SQL over the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from compare import rows_of

TABLES = Path("/root/testdata/sf0.001")


def check(spark, module, name):
    if not TABLES.exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in TABLES.iterdir():
        con.execute(f"create view {p.stem} as select * from '{p}'")
    want = con.execute(module.SQL[name]).df()
    got = module.QUERIES[name](spark, str(TABLES)).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
