"""Simulated paths of state models; each path is a row of work that Spark spreads."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _chain(rng: np.random.Generator, start: np.ndarray, trans: np.ndarray, n: int) -> np.ndarray:
    steps, u = np.cumsum(trans, 1), rng.random(n)
    out = np.empty(n, int)
    k = int(np.searchsorted(np.cumsum(start), u[0]).clip(0, len(start) - 1))
    for i in range(n):
        out[i] = k
        if i + 1 < n:
            k = int(np.searchsorted(steps[k], u[i + 1]).clip(0, len(start) - 1))
    return out


def _paths(spark: SparkSession, n_paths: int, one) -> DataFrame:
    def run(frames):
        for frame in frames:
            for path in frame["id"]:
                state, ret = one(int(path))
                yield pd.DataFrame({"path": path, "step": np.arange(len(ret)), "ret": ret, "state": state})

    return spark.range(n_paths).mapInPandas(run, "path long, step long, ret double, state int")


def gaussian_paths(spark: SparkSession, means, covs, trans, start, n_paths: int = 100, horizon: int = 252, seed: int = 42) -> DataFrame:
    """path, step, ret, state; a step's return is the mean over the features of a draw from its state."""
    means, covs, trans, start = (np.asarray(x, float) for x in (means, covs, trans, start))
    roots = np.linalg.cholesky(covs)

    def one(path: int):
        rng = np.random.default_rng(seed + path)
        state = _chain(rng, start, trans, horizon)
        z = rng.standard_normal((horizon, means.shape[1]))
        return state, (means[state] + np.einsum("tij,tj->ti", roots[state], z)).mean(1)

    return _paths(spark, n_paths, one)


def garch_paths(spark: SparkSession, params: list[dict], trans, start, n_paths: int = 100, horizon: int = 252, seed: int = 42) -> DataFrame:
    """Only the active state's variance moves on."""
    trans, start = np.asarray(trans, float), np.asarray(start, float)

    def one(path: int):
        rng = np.random.default_rng(seed + path)
        state, z = _chain(rng, start, trans, horizon), rng.standard_normal(horizon)
        var = [p["omega"] / max(1 - p["alpha"] - p["beta"], 1e-6) for p in params]
        ret = np.empty(horizon)
        for i, k in enumerate(state):
            p = params[k]
            ret[i] = p.get("mu", 0.0) + np.sqrt(var[k]) * z[i]
            var[k] = max(p["omega"] + p["alpha"] * (ret[i] - p.get("mu", 0.0)) ** 2 + p["beta"] * var[k], 1e-12)
        return state, ret

    return _paths(spark, n_paths, one)


def path_stats(paths: DataFrame, ann: float = 252.0) -> DataFrame:
    """Return, volatility, Sharpe ratio and drawdown of each path."""
    up = Window.partitionBy("path").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    rows = paths.withColumn("level", F.product(1 + F.col("ret")).over(up)).withColumn("dd", (F.max("level").over(up) - F.col("level")) / F.max("level").over(up))
    vol = F.stddev_samp("ret") * ann**0.5
    return rows.groupBy("path").agg((F.exp(F.sum("ret")) - 1).alias("total_return"), vol.alias("vol"), F.when(vol > 0, F.avg("ret") * ann / vol).alias("sharpe"), F.max("dd").alias("max_drawdown"))


def scenario_stats(paths: DataFrame) -> DataFrame:
    """One row over all paths."""
    s = path_stats(paths)
    q = s.agg(F.percentile("total_return", 0.05).alias("q")).first()["q"]
    return s.agg(
        F.avg("total_return").alias("mean_total_return"),
        F.stddev_pop("total_return").alias("std_total_return"),
        F.percentile("total_return", 0.05).alias("var_95"),
        F.avg(F.when(F.col("total_return") <= F.lit(q), F.col("total_return"))).alias("cvar_95"),
        F.avg("max_drawdown").alias("mean_max_drawdown"),
        F.percentile("max_drawdown", 0.95).alias("p95_max_drawdown"),
        F.avg("sharpe").alias("mean_sharpe"),
    )


def stress(spark: SparkSession, tails: list[dict], weights: list[float], n: int = 1000, seed: int = 42) -> DataFrame:
    """Losses drawn from the states' generalised Pareto tails, as many a state as its weight says."""

    def run(frames):
        for frame in frames:
            for k in frame["id"]:
                t = tails[int(k)]
                u = np.random.default_rng(seed + int(k)).random(max(1, round(weights[int(k)] * n)))
                y = -t["sigma"] * np.log1p(-u) if abs(t["xi"]) < 1e-10 else t["sigma"] / t["xi"] * ((1 - u) ** -t["xi"] - 1)
                yield pd.DataFrame({"state": int(k), "loss": t["threshold"] + y})

    return spark.range(len(tails)).mapInPandas(run, "state int, loss double")
