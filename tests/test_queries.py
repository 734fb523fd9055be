"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from peakweave.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in sorted(Path(SF).glob("*.parquet")):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    return x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    cursor = con.execute(ORACLES[name])
    theirs_columns = [d[0] for d in cursor.description]
    assert sorted(theirs_columns) == columns
    at = [theirs_columns.index(c) for c in columns]
    theirs = sorted(repr([plain(r[i]) for i in at]) for r in cursor.fetchall())
    assert ours == theirs


def test_queries_without_sql_run(spark):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, SF).count() > 0
