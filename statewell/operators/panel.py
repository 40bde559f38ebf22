"""Series side by side: vector autoregressions and mean-variance portfolios by state.

Series of a panel are few beside bars (their names are columns); Spark sums weighted
moments by state, and what is left are small matrices, one a state.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.posterior import gaussian_posterior
from ..functions.rolling import order
from . import dense
from . import portfolio as pf


def side_by_side(df: DataFrame, centres: Sequence[float], sd: float, ret: str = "ret", lags: int = 1, scale: float = 100.0) -> tuple[DataFrame, list[str]]:
    """Returns of all series at the times all have, their last ``lags`` returns, and a row with weight w for each state.

    Columns are the series' names and ``<name>_<lag>``; lags are taken within each series. States are those of the
    mean return times ``scale`` under Gaussians at ``centres``; -1 is all bars, with weight 1.
    """
    for i in range(1, lags + 1):
        df = df.withColumn(f"__{i}", F.lag(ret, i).over(order()))
    names = [x.series for x in df.select("series").distinct().orderBy("series").collect()]
    wide = df.groupBy("t").pivot("series", names).agg(F.first(ret).alias("0"), *(F.first(f"__{i}").alias(str(i)) for i in range(1, lags + 1))).na.drop()
    wide = wide.select("t", *(F.col(f"{n}_0").alias(n) for n in names), *(F.col(f"{n}_{i}") for i in range(1, lags + 1) for n in names))
    mean = sum((F.col(n) for n in names), F.lit(0.0)) / len(names) * scale
    weights = F.array_append(gaussian_posterior(mean, centres, sd), F.lit(1.0))
    rows = wide.select("*", F.posexplode(weights).alias("k", "w")).withColumn("state", F.when(F.col("k") == len(centres), -1).otherwise(F.col("k")))
    return rows.withColumn("series", F.lit("panel")), names


def _by_state(rows: DataFrame, columns: list[str], make, kinds: str) -> DataFrame:
    def each(found, weights, mean, cov):
        for k, w, m, c in zip(found, weights, mean, cov):
            yield from ((int(k), *row) for row in make(w, m, c))

    return dense.by_series(dense.weighted_moments(rows, columns, ["series", "state"]), each, f"state int, {kinds}").drop("series")


def _lagged(names: list[str], lags: int) -> list[str]:
    return [*names, *(f"{n}_{i}" for i in range(1, lags + 1) for n in names)]


def autoregression(rows: DataFrame, names: list[str], lags: int = 1) -> DataFrame:
    """state, response, cause, lag and coefficient of each state's vector autoregression; cause "" is the intercept."""

    def make(w, m, c):
        intercept, coefficients, _ = dense.var_model(m, c, len(names), lags, weight=w)
        for i, a in enumerate(names):
            yield a, "", 0, float(intercept[i])
            yield from ((a, b, n + 1, float(coefficients[n][i, j])) for n in range(lags) for j, b in enumerate(names))

    return _by_state(rows, _lagged(names, lags), make, "response string, cause string, lag int, coefficient double")


def impulse_responses(rows: DataFrame, names: list[str], lags: int = 1, horizons: int = 10) -> DataFrame:
    """state, shock, horizon, response_of, response: what a shock of one deviation does to all series."""

    def make(w, m, c):
        _, coefficients, residual = dense.var_model(m, c, len(names), lags, weight=w)
        for i, shock in enumerate(names):
            for h, row in enumerate(dense.impulse_response(coefficients, residual, i, horizons)):
                yield from ((shock, h, name, float(v)) for name, v in zip(names, row))

    return _by_state(rows, _lagged(names, lags), make, "shock string, horizon int, response_of string, response double")


def granger(rows: DataFrame, names: list[str], lags: int = 1) -> DataFrame:
    """state, cause, effect, strength: how much each series' past moves each other, over all lags."""

    def make(w, m, c):
        effect = dense.granger(dense.var_model(m, c, len(names), lags, weight=w)[1])
        return [(a, b, float(effect[j, i])) for i, a in enumerate(names) for j, b in enumerate(names)]

    return _by_state(rows, _lagged(names, lags), make, "cause string, effect string, strength double")


def _ridged(c: np.ndarray, ridge: float) -> np.ndarray:
    return c + ridge * np.eye(len(c))


def mean_variance(rows: DataFrame, names: list[str], ridge: float = 1e-6) -> DataFrame:
    """state, asset, weights of least variance and of the best ratio."""

    def make(w, m, c):
        return zip(names, pf.min_variance(_ridged(c, ridge)).tolist(), pf.max_sharpe(m, _ridged(c, ridge)).tolist())

    return _by_state(rows, names, make, "asset string, min_variance double, max_sharpe double")


def blended(rows: DataFrame, best: DataFrame, weight: str = "max_sharpe") -> DataFrame:
    """t, asset, weight: the states' weights mixed by each bar's posterior."""
    own = rows.where("state >= 0").select("t", "state", "w").join(best.where("state >= 0").select("state", "asset", weight), "state")
    return own.groupBy("t", "asset").agg((F.sum(F.col("w") * F.col(weight)) / F.sum("w")).alias("weight"))


def frontier(rows: DataFrame, names: list[str], points: int = 30, ridge: float = 1e-6) -> DataFrame:
    """state, point, volatility, mean, sharpe and weights (as ``names``) of mixes between the two portfolios of each state."""

    def make(w, m, c):
        for i, (x, vol, mean) in enumerate(pf.frontier(m, _ridged(c, ridge), points)):
            yield i, vol, mean, mean / vol if vol > 0 else None, x

    return _by_state(rows, names, make, "point int, volatility double, mean double, sharpe double, weights array<double>")


def black_litterman(rows: DataFrame, names: list[str], views: dict[str, float], confidence: float = 1.0, posterior: Sequence[float] | None = None, tau: float = 0.05, ridge: float = 1e-6) -> DataFrame:
    """state, asset, posterior_mean: each state's means drawn toward views; a series without one keeps its pull to the prior only."""

    def make(w, m, c):
        view = np.array([views.get(n, 0.0) for n in names])
        trust = np.array([confidence if n in views else 0.0 for n in names])
        return zip(names, pf.black_litterman(m, _ridged(c, ridge), view, trust, tau, posterior).tolist())

    return _by_state(rows, names, make, "asset string, posterior_mean double")
