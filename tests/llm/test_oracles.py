"""Queries against their SQL."""

import os

import duckdb
import pytest

from statewell.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_are_those_of_the_sql(spark, sf, name):
    duck = duckdb.connect()
    for f in os.listdir(sf):
        duck.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    want = duck.sql(ORACLES[name])
    df = QUERIES[name](spark, sf)
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(repr(tuple(r[c] for c in want.columns)) for r in df.collect()) == sorted(map(repr, want.fetchall()))
