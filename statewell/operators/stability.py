"""How much fits with other seeds agree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import hmm
from .dense import rand_index


def across_seeds(df: DataFrame, features: list[str], k: int, runs: int = 3, restarts: int = 10, seed: int = 42, **options) -> DataFrame:
    """series, mean and least adjusted Rand index over all pairs of runs, spread of means and transitions (unaligned).

    A series is a task's work; its runs are few.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("t", kind="stable")
        raw = group[features].to_numpy(float)
        x, mean, sd = hmm.standardise(raw)
        seeds = [seed + 100 * i + j for i in range(runs) for j in range(restarts)]
        models = hmm.best_of(hmm.fit_many(x, k, seeds, **options), lambda m: (m["seed"] - seed) // 100)
        paths = [hmm.decode(m | {"mean": mean, "sd": sd}, raw)["state"] for m in models]
        index = [rand_index(np.histogram2d(a, b, bins=k, range=[[-0.5, k - 0.5]] * 2)[0]) for i, a in enumerate(paths) for b in paths[:i]]
        spread = lambda name: float(np.std([m[name] for m in models], 0).mean())
        return pd.DataFrame([{"series": group["series"].iloc[0], "mean_ari": float(np.mean(index)), "min_ari": float(np.min(index)), "transition_std": spread("trans"), "mean_std": spread("means")}])

    return df.select("series", "t", *features).groupBy("series").applyInPandas(run, "series string, mean_ari double, min_ari double, transition_std double, mean_std double")
