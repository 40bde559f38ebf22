"""Small dense algebra after Spark has summed: factors, VAR, Gaussian distances."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weighted_moments(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """A row for each key with weight sw, means and covariances (arrays) of ``columns``; w are weights."""
    d = len(columns)
    w = F.col("w")
    m = df.groupBy(*keys).agg(F.sum(w).alias("sw"), *[F.try_divide(F.sum(w * F.col(c)), F.sum(w)).alias(f"__m{i}") for i, c in enumerate(columns)])
    dev = [F.col(c) - F.col(f"__m{i}") for i, c in enumerate(columns)]
    mixed = {(i, j): F.try_divide(F.sum(w * dev[i] * dev[j]), F.sum(w)) for i in range(d) for j in range(i, d)}
    cov = F.array(*[F.array(*[mixed[min(i, j), max(i, j)] for j in range(d)]) for i in range(d)])
    mean = F.array(*[F.first(f"__m{i}") for i in range(d)])
    return df.join(m, keys).groupBy(*keys).agg(F.first("sw").alias("sw"), mean.alias("mean"), cov.alias("cov"))


def weighted_sums(df: DataFrame, columns: list[str], keys: list[str]) -> dict[tuple, tuple[float, np.ndarray, np.ndarray]]:
    """The same by key on the driver, for keys that are few, such as states."""
    return {tuple(r[k] for k in keys): (r["sw"], np.array(r["mean"]), np.array(r["cov"])) for r in weighted_moments(df, columns, keys).collect()}


def by_series(moments: DataFrame, make, columns: str) -> DataFrame:
    """The rows ``make(states, weights, means, covariances)`` gives for the moments of each series' states."""
    names = ["series", *[x.split()[0] for x in columns.split(", ")]]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g[g["sw"] > 0].sort_values("state")
        mean, cov = np.array(g["mean"].tolist()), np.array([np.array(x.tolist()) for x in g["cov"]])
        rows = make(g["state"].tolist(), g["sw"].to_numpy(), mean, cov) if len(g) else []
        return pd.DataFrame([(g["series"].iloc[0], *row) for row in rows], columns=names)

    return moments.groupBy("series").applyInPandas(run, f"series string, {columns}")


def distances(states, weights, mean, cov):
    """All distances between each two states' Gaussians."""
    for i in range(len(states)):
        for j in range(i + 1, len(states)):
            p, q = (mean[i], cov[i]), (mean[j], cov[j])
            d = bhattacharyya(*p, *q)
            yield states[i], states[j], kl(*p, *q), symmetric_kl(*p, *q), d, float(np.exp(-d)), mahalanobis(mean[i], mean[j], (cov[i] + cov[j]) / 2)


def principal(cov: np.ndarray, n: int, reference: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Loadings (columns) and shares of variance; signs as in ``reference`` or with a positive sum."""
    values, vectors = np.linalg.eigh(cov + 1e-10 * np.eye(len(cov)))
    values, vectors = values[::-1][:n], vectors[:, ::-1][:, :n]
    for k in range(vectors.shape[1]):
        toward = vectors[:, k] @ reference[:, k] if reference is not None else vectors[:, k].sum()
        if toward < 0:
            vectors[:, k] *= -1
    return vectors, values / (np.trace(cov) + 1e-15)


def factor_stability(loadings: list[np.ndarray]) -> np.ndarray:
    """Mean absolute cosine of each factor over all pairs of states."""
    pairs = [(a, b) for i, a in enumerate(loadings) for b in loadings[:i]]
    if not pairs:
        return np.ones(loadings[0].shape[1])
    return np.mean([np.abs((a * b).sum(0)) / (np.linalg.norm(a, axis=0) * np.linalg.norm(b, axis=0) + 1e-15) for a, b in pairs], 0)


def var_model(mean: np.ndarray, cov: np.ndarray, d: int, lags: int, ridge: float = 1e-6, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intercept, coefficients (lags, d, d) and residual covariance of a vector autoregression.

    From the joint mean and covariance of (r_t, r_t-1, ...): slopes solve the normal
    equations around the mean, which leaves the intercept unpenalised.
    """
    sxx, sxy, syy = cov[d:, d:], cov[d:, :d], cov[:d, :d]
    b = np.linalg.solve(sxx + ridge / weight * np.eye(d * lags), sxy)
    residual = syy - b.T @ sxy - sxy.T @ b + b.T @ sxx @ b
    return mean[:d] - b.T @ mean[d:], b.T.reshape(d, lags, d).transpose(1, 0, 2), residual


def impulse_response(coefficients: np.ndarray, residual: np.ndarray, shock: int, horizons: int = 10) -> np.ndarray:
    lags, d, _ = coefficients.shape
    try:
        root = np.linalg.cholesky(residual)
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(residual)
        root = vectors * np.sqrt(np.maximum(values, 0))
    past = [root[:, shock]] + [np.zeros(d)] * (lags - 1)
    out = [past[0]]
    for _ in range(horizons):
        new = sum(a @ x for a, x in zip(coefficients, past))
        out.append(new)
        past = [new, *past[:-1]]
    return np.array(out)


def granger(coefficients: np.ndarray) -> np.ndarray:
    """Summed absolute effect of each column's past on each row."""
    return np.abs(coefficients).sum(0)


def kl(mp, cp, mq, cq) -> float:
    try:
        np.linalg.cholesky(cp), np.linalg.cholesky(cq)
    except np.linalg.LinAlgError:
        return float("nan")
    d = mq - mp
    return float(0.5 * (np.trace(np.linalg.solve(cq, cp)) + d @ np.linalg.solve(cq, d) - len(mp) + np.linalg.slogdet(cq)[1] - np.linalg.slogdet(cp)[1]))


def symmetric_kl(mp, cp, mq, cq) -> float:
    """Half the sum of both directions."""
    return 0.5 * (kl(mp, cp, mq, cq) + kl(mq, cq, mp, cp))


def bhattacharyya(mp, cp, mq, cq) -> float:
    """With a quarter of the squared distance, not the usual eighth."""
    c, d = (cp + cq) / 2, mq - mp
    return float(0.25 * d @ np.linalg.solve(c, d) + 0.5 * (np.linalg.slogdet(c)[1] - 0.5 * (np.linalg.slogdet(cp)[1] + np.linalg.slogdet(cq)[1])))


def mahalanobis(mp, mq, pooled) -> float:
    d = mq - mp
    return float(np.sqrt(max(d @ np.linalg.solve(pooled, d), 0)))


def rand_index(counts: np.ndarray) -> float:
    """Adjusted Rand index of a contingency table."""
    pairs = lambda x: (x * (x - 1) / 2).sum()
    n = counts.sum()
    a, b, both = pairs(counts.sum(1)), pairs(counts.sum(0)), pairs(counts)
    expect = a * b / (n * (n - 1) / 2) if n > 1 else 0
    most = (a + b) / 2
    return float((both - expect) / (most - expect)) if most != expect else 1.0
