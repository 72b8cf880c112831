"""Every registered query against its SQL, on the smallest tables."""

import datetime as dt
import math
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry
from tickerloom.plans import all_checks, all_queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return c


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{round(x, 6) + 0.0:.6f}"
    return x.isoformat() if isinstance(x, dt.datetime) else str(x)


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(all_queries()))
def test_query(spark, con, name):
    df = all_queries()[name](spark, SF)
    got = _rows(df.collect(), df.columns)
    sql = all_checks().get(name)
    if sql is None:
        assert got
        return
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == _rows(cur.fetchall(), cols)


def test_entry(spark):
    df = entry(spark)
    assert df.columns[:2] == ["ticker", "hour"] and df.count() >= 0
