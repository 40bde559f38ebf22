"""Every query runs, and gives the rows of its SQL where it has some."""

import os

import duckdb
import pytest

from statewell.plans.registry import ORACLES, QUERIES

#: Twelve months of days are needed, or more common hours than the smallest tables have.
LARGER = {"stress_losses", "walk_forward_folds", "walk_forward_backtest", "regime_var", "granger_table", "mean_variance", "blended_mean_variance", "efficient_frontier", "black_litterman", *(n for n in QUERIES if "corr" in n or "agreement" in n)}


@pytest.fixture(scope="module")
def duck():
    out = {}
    for sf in ("sf0.001", "sf0.01"):
        out[sf] = duckdb.connect()
        for f in os.listdir(f"/root/testdata/{sf}"):
            out[sf].execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '/root/testdata/{sf}/{f}'")
    return out


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    sf = "sf0.01" if name in LARGER else "sf0.001"
    df = QUERIES[name](spark, f"/root/testdata/{sf}")
    rows = df.collect()
    assert rows
    if name in ORACLES:
        want = duck[sf].sql(ORACLES[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert sorted(repr(tuple(r[c] for c in want.columns)) for r in rows) == sorted(map(repr, want.fetchall()))
