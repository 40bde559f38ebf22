"""Factors by state: exposures, projections and what they explain."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.posterior import dot, numbers
from .dense import by_series as dense_rows
from .dense import factor_stability, principal, weighted_moments, weighted_sums


def fit(df: DataFrame, columns: list[str], n: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """State to mean, loadings and shares of variance over all series; -1 is all bars, whose signs the others take."""
    rows = df.select(*columns, F.posexplode("posterior").alias("state", "w")).unionByName(df.select(*columns, F.lit(-1).alias("state"), F.lit(1.0).alias("w")))
    sums = weighted_sums(rows, columns, ["state"])
    whole, share = principal(sums[(-1,)][2], n)
    out = {-1: (sums[(-1,)][1], whole, share)}
    for (k,), (_, mean, cov) in sorted(sums.items()):
        if k >= 0:
            out[k] = (mean, *principal(cov, n, whole))
    return out


def by_series(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """series, state (-1: all bars), factor, share of variance, loadings (as ``columns``), similarity and stability.

    similarity: cosine of a state's loadings with those of all bars, whose signs they take;
    stability: mean absolute cosine of a factor over all pairs of the series' states.
    """
    rows = df.select("series", *columns, F.posexplode("posterior").alias("state", "w")).unionByName(df.select("series", *columns, F.lit(-1).alias("state"), F.lit(1.0).alias("w")))

    def make(found, weights, mean, cov):
        at = {k: c for k, c in zip(found, cov)}
        whole, share = principal(at[-1], n)
        each = {-1: (whole, share)} | {k: principal(c, n, whole) for k, c in at.items() if k >= 0}
        steady = factor_stability([v for k, (v, _) in each.items() if k >= 0] or [whole])
        for k, (loadings, shares) in sorted(each.items()):
            near = (loadings * whole).sum(0) / (np.linalg.norm(loadings, axis=0) * np.linalg.norm(whole, axis=0) + 1e-15)
            for j in range(loadings.shape[1]):
                yield (int(k), j, float(shares[j]), loadings[:, j].tolist(), float(near[j]), float(steady[j]))

    return dense_rows(weighted_moments(rows, columns, ["series", "state"]), make, "state int, factor int, share double, loadings array<double>, similarity double, stability double")


def _blend(values: list[float]) -> Column:
    return dot(F.col("posterior"), numbers(values))


def exposure(df: DataFrame, model: dict, column: int) -> DataFrame:
    """``df`` with the posterior's blend of a column's loadings: loading_0, loading_1, ..."""
    states = sorted(k for k in model if k >= 0)
    for j in range(model[-1][1].shape[1]):
        df = df.withColumn(f"loading_{j}", _blend([float(model[k][1][column, j]) for k in states]))
    return df


def project(df: DataFrame, columns: list[str], model: dict) -> DataFrame:
    """``df`` with factor scores: columns less their blended means, times blended loadings."""
    states = sorted(k for k in model if k >= 0)
    centred = [F.col(c) - _blend([float(model[k][0][i]) for k in states]) for i, c in enumerate(columns)]
    for j in range(model[-1][1].shape[1]):
        total = F.lit(0.0)
        for i, x in enumerate(centred):
            total = total + x * _blend([float(model[k][1][i, j]) for k in states])
        df = df.withColumn(f"factor_{j}", total)
    return df


def decompose(df: DataFrame, ret: str, scores: list[str]) -> DataFrame:
    """Contributions of factor scores to returns by least squares without intercept, and what is left."""
    d = len(scores)
    sums = df.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"x{i}_{j}") for i, a in enumerate(scores) for j, b in enumerate(scores)], *[F.sum(F.col(a) * F.col(ret)).alias(f"y{i}") for i, a in enumerate(scores)]).first()
    xx = np.array([[sums[f"x{i}_{j}"] for j in range(d)] for i in range(d)])
    beta = np.linalg.lstsq(xx, np.array([sums[f"y{i}"] for i in range(d)]), rcond=None)[0]
    left = F.col(ret)
    for i, name in enumerate(scores):
        part = F.col(name) * float(beta[i])
        df, left = df.withColumn(f"contribution_{i}", part), left - part
    return df.withColumn("residual", left)
