"""Recursions over a series: one task a series, bars in order of time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def fold(df: DataFrame, kernel: Callable[..., dict[str, object]], inputs: list[str], outputs: dict[str, str]) -> DataFrame:
    """series, t and what ``kernel`` returns for the arrays of ``inputs``.

    ``outputs`` maps names to SQL types. Array columns arrive as matrices. A series is a
    chain, so it is one group; series run in parallel.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("t", kind="stable")
        arrays = [np.array(group[x].tolist()) for x in inputs]
        out = kernel(*arrays)
        return pd.DataFrame({"series": group["series"].to_numpy(), "t": group["t"].to_numpy()} | {k: list(v) for k, v in out.items()}, columns=["series", "t", *outputs])

    schema = "series string, t long, " + ", ".join(f"{k} {v}" for k, v in outputs.items())
    return df.select("series", "t", *inputs).groupBy("series").applyInPandas(run, schema)
