"""Lagged second and third moments of long series, and starting models from them.

Bars of a hidden Markov model are, given the states, independent, so products of
consecutive bars have the states' means as components. Spark sums the products; what is
left is one small tensor a series. Features are scaled by their deviations but not
centred: centred means depend on each other linearly, and one component would be lost.
"""

from __future__ import annotations

from itertools import permutations, product

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scales(rows: DataFrame, features: list[str]) -> DataFrame:
    """series, bars, mean and sd (arrays; 1 where a feature is constant)."""
    sd = [F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0) for c in features]
    return rows.groupBy("series").agg(F.count("*").alias("bars"), F.array(*(F.avg(c) for c in features)).alias("mean"), F.array(*sd).alias("sd"))


def lagged_moments(rows: DataFrame, features: list[str], scale: DataFrame | None = None) -> DataFrame:
    """series, bars, mean, sd, m2 (flat d x d: lag one) and m3 (flat d x d x d: lags one and two).

    ``rows`` come from ``scan.block_rows``. A block also gets the first two bars of the next
    one, so products reach across blocks and no window holds a series.
    """
    d = len(features)
    scale = scales(rows, features) if scale is None else scale
    size = rows.groupBy("series", "block").agg(F.min("n").alias("first"))
    z = rows.join(size, ["series", "block"]).join(scale.select("series", "sd"), "series")
    z = z.select("series", "block", "n", "first", F.array(*(F.col(c) / F.col("sd")[i] for i, c in enumerate(features))).alias("z"))
    halo = z.where("block > 0 and n - first < 2").select("series", (F.col("block") - 1).alias("block"), "n", "z", F.lit(False).alias("own"))
    both = z.select("series", "block", "n", "z", F.lit(True).alias("own")).unionByName(halo)
    order = Window.partitionBy("series", "block").orderBy("n")
    both = both.select("series", "own", F.col("z").alias("a"), F.lead("z", 1).over(order).alias("b"), F.lead("z", 2).over(order).alias("c")).where("own and b is not null")
    m2 = F.array(*(F.avg(F.col("a")[i] * F.col("b")[j]) for i, j in product(range(d), repeat=2)))
    m3 = F.array(*(F.avg(F.col("a")[i] * F.col("b")[j] * F.col("c")[k]) for i, j, k in product(range(d), repeat=3)))
    return scale.join(both.groupBy("series").agg(m2.alias("m2"), m3.alias("m3")), "series")


def numpy_moments(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of one series in memory."""
    n = len(z)
    return z[:-1].T @ z[1:] / (n - 1), np.einsum("ta,tb,tc->abc", z[:-2], z[1:-1], z[2:]) / (n - 2)


def tensor_means(m2: np.ndarray, m3: np.ndarray, k: int, rng: np.random.Generator, starts: int = 10, rounds: int = 50) -> np.ndarray | None:
    """Means of ``k`` components from moments of scaled bars; None where they don't hold as many.

    Moments are made symmetric, as the order of bars carries the states' moves and not their means. A
    whitened tensor has the components as orthogonal eigenvectors: all starts are
    iterated side by side, the one of the largest value is taken and deflated.
    """
    values, vectors = np.linalg.eigh((m2 + m2.T) / 2)
    top = np.argsort(-np.abs(values))[:k]
    size = np.abs(values[top])
    if len(top) < k or size.min() < 1e-6:
        return None
    white, colour = vectors[:, top] / np.sqrt(size), vectors[:, top] * np.sqrt(size)
    m3 = sum(m3.transpose(p) for p in permutations(range(3))) / 6
    t = np.einsum("abc,ai,bj,cl->ijl", m3, white, white, white)
    means = []
    for _ in range(k):
        v = rng.normal(size=(starts, k))
        for _ in range(rounds):
            v = np.einsum("ijl,rj,rl->ri", t, v, v) / (np.linalg.norm(v, axis=1, keepdims=True) ** 2 + 1e-300)
            v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-300
        value = np.einsum("ijl,ri,rj,rl->r", t, v, v, v)
        best = int(np.abs(value).argmax())
        means.append(value[best] * colour @ v[best])
        t = t - value[best] * np.einsum("i,j,l->ijl", v[best], v[best], v[best])
    out = np.array(means)
    return out if np.isfinite(out).all() else None
