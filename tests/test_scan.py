"""Recursions over blocks of bars against the same recursions over whole series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statewell.functions.blocks import crossing, numbered, running
from statewell.operators import hmm, scan
from statewell.operators import recursions as rec

START = np.array([0.5, 0.3, 0.2])
TRANS = np.array([[0.7, 0.3, 0.0], [0.25, 0.5, 0.25], [0.1, 0.3, 0.6]])  # one step is impossible
MODEL = scan.gaussian_model(START, TRANS, [-1.0, 0.0, 1.0], [0.8, 0.5, 0.8], "x")
SIZES = {"a": 1000, "b": 1, "c": 64, "d": 65, "e": 700}


@pytest.fixture(scope="module")
def bars(spark):
    r = np.random.default_rng(4)
    parts = []
    for name, n in SIZES.items():
        # most of a's bars lie close together, and c's far apart
        t = np.cumsum(r.integers(1, 3, n)) if name == "a" else np.cumsum(r.integers(1, 10**7, n))
        t[-1:] += 10**6
        parts.append(pd.DataFrame({"series": name, "t": t.astype("int64"), "x": r.normal(0, 1, n), "y": r.normal(0, 1, n).round(1)}))
    frame = pd.concat(parts).sample(frac=1, random_state=1)
    return spark.createDataFrame(frame).repartition(5).cache(), {k: g.sort_values("t") for k, g in frame.groupby("series")}


def test_rows_are_numbered_within_their_series(bars):
    df, by = bars
    got = numbered(df, 64).toPandas()
    for name, g in got.groupby("series"):
        g = g.sort_values("t")
        assert g["n"].tolist() == list(range(SIZES[name])) and (g["block"] == g["n"] // 64).all()
    assert sorted(got.columns) == ["block", "n", "series", "t", "x", "y"]


def test_running_sums_and_selection(bars):
    df, by = bars
    got = running(df, ["series"], ["y", "t"], {"s": F.col("x") * 2, "n": F.lit(1)}).toPandas()
    low = crossing(df, ["series"], ["y", "t"], F.lit(1.0), lambda upto, whole: upto >= 0.3 * whole).groupBy("series").agg(F.min("y").alias("q")).toPandas()
    for name, g in by.items():
        want, mine = g.sort_values(["y", "t"]), got[got["series"] == name].sort_values("n")
        assert mine["t"].tolist() == want["t"].tolist() and mine["n"].tolist() == list(range(1, len(want) + 1))
        assert np.allclose(mine["s"], (want["x"] * 2).cumsum()) and np.allclose(mine["all_s"], want["x"].sum() * 2) and (mine["all_n"] == len(want)).all()
        assert low[low["series"] == name]["q"].item() == want["y"].iloc[int(np.ceil(0.3 * len(want) - 1e-9)) - 1]


def whole(g):
    return scan.density(MODEL, g)[1]


@pytest.mark.parametrize("size", [64, 4096])
def test_blocks_give_the_rows_of_whole_series(bars, size):
    df, by = bars
    rows, models = scan.block_rows(df, ["x"], size), scan.one_model(MODEL, df)
    got = scan.decode(rows, models).toPandas()
    ll = scan.log_likelihood(rows, models).toPandas().set_index("series")["log_likelihood"]
    for name, g in by.items():
        mine, log_b = got[got["series"] == name].sort_values("t"), whole(g)
        assert mine["t"].tolist() == g["t"].tolist()
        assert mine["state"].tolist() == rec.viterbi(log_b, START, TRANS).tolist()
        assert np.allclose(np.array(mine["smoothed"].tolist()), rec.smooth(log_b, START, TRANS))
        assert np.allclose(np.array(mine["filtered"].tolist()), rec.online_filter(log_b, START, TRANS))
        assert np.isclose(ll[name], rec.log_likelihood(log_b, START, TRANS))


@pytest.mark.parametrize("emission", ["gaussian", "student_t"])
@pytest.mark.parametrize("covariance", ["full", "diag", "tied", "spherical"])
def test_a_round_over_blocks_is_a_round(bars, emission, covariance):
    df, by = bars
    model = hmm.first_guess(by["a"][["x", "y"]].to_numpy(), 2, 1, covariance, emission, "kmeans") | {"mean": np.zeros(2), "sd": np.ones(2), "features": ["x", "y"]}
    df = df.where("series in ('a', 'e')")
    got = scan.em_round(scan.block_rows(df, ["x", "y"], 64), scan.one_model(model, df), covariance).collect()
    for row in got:
        want, g = dict(model), by[row.series]
        x, log_b, maha = scan.density(model, g)
        ll, gamma, moves = hmm.expectations(log_b[None], model["start"][None], model["trans"][None])
        hmm.improve(want, x, maha, gamma[0], moves[0], covariance)
        mine = hmm.from_json(row.model)
        assert np.isclose(row.log_likelihood, ll[0])
        for name in ("start", "trans", "means", "covs", *(["dofs"] if emission == "student_t" else [])):
            assert np.allclose(mine[name], want[name], atol=1e-8), name


def test_one_long_series_spreads_over_tasks(spark):
    n = 1_000_000
    i = np.arange(n)
    x = F.sin(F.col("id") * 12.9898) * 2 + F.cos(F.col("id") * 0.001)
    df = spark.range(n).select(F.lit("one").alias("series"), F.col("id").alias("t"), x.alias("x"))
    rows, models = scan.block_rows(df, ["x"]), scan.one_model(MODEL, df)
    log_b = whole(pd.DataFrame({"x": np.sin(i * 12.9898) * 2 + np.cos(i * 0.001)}))
    blocks = rows.withColumn("task", F.spark_partition_id()).groupBy("block", "task").agg(F.count("*").alias("n")).toPandas()
    assert len(blocks) == -(-n // 4096) and blocks["n"].max() == 4096 and blocks["task"].nunique() > 1
    got = scan.viterbi(rows, models).groupBy("value").count().toPandas().set_index("value")["count"]
    assert got.to_dict() == pd.Series(rec.viterbi(log_b, START, TRANS)).value_counts().to_dict()
    ll = scan.log_likelihood(rows, models).first()["log_likelihood"]
    assert np.isclose(ll, hmm.expectations(log_b[None], START[None], TRANS[None])[0][0])
