"""Dwell times as negative binomials, corrections by them, and next-state prediction."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .states import runs


def fit_durations(df: DataFrame) -> DataFrame:
    """series, state, r, p, mean by moments of run lengths; geometric where they vary too little."""
    d = runs(df).groupBy("series", "state").agg((F.avg("length") - 1).alias("e"), F.coalesce(F.var_samp("length"), F.lit(0.0)).alias("v"), F.count("*").alias("n_runs"))
    over = (F.col("v") > F.col("e")) & (F.col("e") > 0)
    p = F.when(over, (F.col("v") - F.col("e")) / F.col("v")).when(F.col("e") > 0, F.greatest(1 - 1 / F.greatest(F.col("e"), F.lit(1e-9)), F.lit(0.0))).otherwise(0.5)
    r = F.when(over, F.col("e") * (1 - p) / p).otherwise(1.0)
    clip = lambda c, a, b: F.greatest(F.least(c, F.lit(b)), F.lit(a))
    out = d.select("series", "state", "n_runs", clip(r, 0.5, 50.0).alias("r"), clip(p, 0.01, 0.99).alias("p"))
    return out.withColumn("mean_duration", F.col("r") * F.col("p") / (1 - F.col("p")) + 1)


def duration_log_pmf(d: int, r: float, p: float) -> float:
    if d < 1:
        return -math.inf
    k = d - 1
    return math.lgamma(k + r) - math.lgamma(r) - math.lgamma(k + 1) + r * math.log(1 - p) + k * math.log(p)


def correct(state: np.ndarray, posterior: np.ndarray, durations: list[tuple[float, float]], most: int = 200) -> np.ndarray:
    """Posteriors weighted by how much likelier the run so far is than under geometric dwell."""
    length = np.ones(len(state), int)
    for i in range(1, len(state)):
        length[i] = length[i - 1] + 1 if state[i] == state[i - 1] else 1

    def weight(k: int, d: int) -> float:
        r, p = durations[k]
        mean = r * p / (1 - p) + 1
        g = min(max(1 - 1 / max(mean, 1.0001), 1e-6), 1 - 1e-6)
        return math.exp(min(duration_log_pmf(d, r, p) - (math.log(1 - g) + (d - 1) * math.log(g)), 50))

    table = np.array([[weight(k, d) for d in range(1, most + 1)] for k in range(len(durations))])
    w = np.repeat(table[:, 0][None], len(state), 0)
    w[np.arange(len(state)), state] = table[state, np.minimum(length, most) - 1]
    out = posterior * w
    total = out.sum(1, keepdims=True)
    return np.where(total > 0, out / np.where(total > 0, total, 1), posterior)


class NextState:
    """Softmax regression of a state on the features of the bars before it, by Newton steps.

    The penalised likelihood has one maximum, so there is no start to choose; slopes and
    intercepts share the ridge ``l2``, which makes the Hessian definite.
    """

    def __init__(self, lags: int = 1, l2: float = 0.01, rounds: int = 50, tol: float = 1e-8) -> None:
        self.lags, self.l2, self.rounds, self.tol = lags, l2, rounds, tol

    def history(self, x: np.ndarray) -> np.ndarray:
        """For each bar from the ``lags``-th on, and for the bar to come, the bars before it, latest first."""
        view = np.lib.stride_tricks.sliding_window_view(x, self.lags, axis=0)[:, :, ::-1]
        return view.transpose(0, 2, 1).reshape(len(view), -1)

    def fit(self, x: np.ndarray, state: np.ndarray) -> NextState:
        past, label = self.history(x)[:-1], np.asarray(state)[self.lags :]
        self.centre, self.scale = past.mean(0), past.std(0) + 1e-10
        a = self.rows(past)
        n, d = a.shape
        k = int(np.max(state)) + 1
        hit = (label[:, None] == np.arange(k)).astype(float)
        self.coefficients = np.zeros((d, k))
        for _ in range(self.rounds):
            p = self.shares(a)
            slope = a.T @ (hit - p) / n - self.l2 * self.coefficients
            curve = np.einsum("ni,nj,nk,kl->kilj", a, a, p, np.eye(k), optimize=True) - np.einsum("ni,nj,nk,nl->kilj", a, a, p, p, optimize=True)
            step = np.linalg.solve(curve.reshape(k * d, k * d) / n + self.l2 * np.eye(k * d), slope.T.ravel()).reshape(k, d).T
            self.coefficients += step
            if np.abs(step).max() < self.tol:
                break
        return self

    def rows(self, past: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(past), 1)), (past - self.centre) / self.scale])

    def shares(self, a: np.ndarray) -> np.ndarray:
        score = a @ self.coefficients
        score = np.exp(score - score.max(1)[:, None])
        return score / score.sum(1)[:, None]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """State probabilities of the bars from the ``lags``-th on and of the bar to come."""
        return self.shares(self.rows(self.history(x)))


def blend(posterior: np.ndarray, predicted: np.ndarray, alpha: float = 0.5) -> np.ndarray:
    """Mix of both over the rows they share at the end."""
    n = min(len(posterior), len(predicted))
    out = alpha * posterior[-n:] + (1 - alpha) * predicted[-n:]
    return out / out.sum(1, keepdims=True)
