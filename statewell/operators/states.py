"""Runs of states, transitions and what follows from a transition matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import order, run_number


def run_lengths(df: DataFrame) -> DataFrame:
    """The length so far of the run that each row is in, as run_length."""
    df = df.withColumn("run", run_number())
    return df.withColumn("run_length", F.row_number().over(Window.partitionBy("series", "run").orderBy("t")))


def runs(df: DataFrame) -> DataFrame:
    """A row for each run: series, run, state, start, end (start of the next run, or last bar), length."""
    spans = df.withColumn("run", run_number()).groupBy("series", "run").agg(F.first("state").alias("state"), F.min("t").alias("start"), F.max("t").alias("last"), F.count("*").alias("length"))
    nxt = F.lead("start").over(Window.partitionBy("series").orderBy("run"))
    return spans.withColumn("end", F.coalesce(nxt, "last")).drop("last")


def dwell_times(df: DataFrame) -> DataFrame:
    """Mean, median, largest and number of run lengths by state."""
    return runs(df).groupBy("series", "state").agg(F.avg("length").alias("mean_dwell"), F.percentile("length", 0.5).alias("median_dwell"), F.max("length").alias("max_dwell"), F.count("*").alias("n_runs"))


def transition_counts(df: DataFrame) -> DataFrame:
    pairs = df.select("series", "state", F.lead("state").over(order()).alias("to")).where("to is not null")
    return pairs.groupBy("series", "state", "to").count()


def transition_matrix(df: DataFrame) -> DataFrame:
    """Empirical probabilities (series, state, to, p); pairs never seen are left out."""
    n = transition_counts(df)
    return n.withColumn("p", F.col("count") / F.sum("count").over(Window.partitionBy("series", "state"))).drop("count")


def expected_dwell(matrix: np.ndarray) -> np.ndarray:
    return 1 / np.maximum(1 - np.diag(matrix), 1e-9)


def additional_dwell(matrix: np.ndarray, state: int, most: float = 200) -> float:
    """Expected further bars in a state."""
    p = matrix[state, state]
    return float(most) if p >= 1 else min(p / (1 - p), most)


def stationary(matrix: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eig(matrix.T)
    v = np.abs(np.real(vectors[:, np.argmin(np.abs(values - 1))]))
    return v / v.sum()


def row_entropy(matrix: np.ndarray) -> np.ndarray:
    return -(matrix * np.log(np.where(matrix > 0, matrix, 1))).sum(1)


def entropy_rate(matrix: np.ndarray) -> float:
    return float(stationary(matrix) @ row_entropy(matrix))


def power(matrix: np.ndarray, steps: int) -> np.ndarray:
    """Transition probabilities over ``steps`` bars, rows summing to one."""
    if steps <= 0:
        return np.eye(len(matrix))
    out = np.linalg.matrix_power(matrix, steps)
    return out / out.sum(1, keepdims=True)


def forecast(matrix: np.ndarray, horizons=(1, 6, 24, 72, 168)) -> list[tuple[int, int, int, float]]:
    """(horizon, state, to, p) for all states."""
    return [(h, i, j, float(power(matrix, h)[i, j])) for h in sorted(horizons) for i in range(len(matrix)) for j in range(len(matrix))]


def occupancy(matrix: np.ndarray, state: int, horizon: int) -> list[float]:
    """Probability of being in ``state`` after 1 to ``horizon`` bars."""
    return [float(power(matrix, h)[state, state]) for h in range(1, horizon + 1)]


def run_drawdown(df: DataFrame, ret: str) -> DataFrame:
    """Largest relative drawdown within any one run of each state, 0 to 1."""
    run = Window.partitionBy("series", "run").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("run", run_number()).withColumn("level", F.exp(F.sum(ret).over(run)))
    rows = rows.withColumn("dd", 1 - F.col("level") / F.max("level").over(run))
    return rows.groupBy("series", "state").agg(F.max("dd").alias("max_drawdown"))


def current_state(df: DataFrame) -> DataFrame:
    """The last bar of each series with its state and how long it has lasted."""
    at = F.struct("t")
    return run_lengths(df).groupBy("series").agg(F.max("t").alias("t"), F.max_by("state", at).alias("state"), F.max_by("run_length", at).alias("run_length"))




def chains(df: DataFrame, k: int, make, columns: str) -> DataFrame:
    """The rows ``make(matrix)`` gives for the empirical transition matrix of each series.

    A state that is never left for another bar stays. One matrix is one small group.
    """
    import pandas as pd

    names = ["series", *[x.split()[0] for x in columns.split(", ")]]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((k, k))
        m[g["state"], g["to"]] = g["p"]
        m[m.sum(1) == 0] = np.eye(k)[m.sum(1) == 0]
        return pd.DataFrame([(g["series"].iloc[0], *row) for row in make(m)], columns=names)

    return transition_matrix(df).groupBy("series").applyInPandas(run, f"series string, {columns}")


def labels(df: DataFrame, ret: str = "ret", volatility: str | None = None) -> DataFrame:
    """series, state, mean, label and volatility_rank: states named by their rank of mean return.

    Two states are bearish and bullish, three low, mid and high, more have their rank. The
    volatility rank is that of the mean of ``volatility``, or of the deviation of returns.
    """
    risk = F.avg(volatility) if volatility else F.stddev_samp(ret)
    by = df.groupBy("series", "state").agg(F.avg(ret).alias("mean"), F.coalesce(risk, F.lit(0.0)).alias("__risk"))
    series = Window.partitionBy("series")
    rank = F.row_number().over(series.orderBy("mean", "state"))
    by = by.withColumn("__rank", rank).withColumn("__n", F.count("*").over(series))
    label = F.when(F.col("__n") == 2, F.try_element_at(F.array(F.lit("bearish"), F.lit("bullish")), F.col("__rank"))).when(F.col("__n") == 3, F.try_element_at(F.array(F.lit("low"), F.lit("mid"), F.lit("high")), F.col("__rank"))).otherwise((F.col("__rank") - 1).cast("string"))
    order_ = F.row_number().over(series.orderBy("__risk", "state")) - 1
    return by.select("series", "state", "mean", label.alias("label"), order_.alias("volatility_rank"))
