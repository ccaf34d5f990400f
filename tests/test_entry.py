"""The registry, and a few queries against their oracles."""

import os

import pytest

import __spark_entry__ as entry
from graphloom.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
@pytest.mark.parametrize("name", sorted(ORACLES)[::5])
def test_against_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(df):
        text = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
        return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))

    assert rows(got) == rows(want)
