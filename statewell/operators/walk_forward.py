"""Monthly walk-forward: fit on a trailing window, decode the month after it, causally."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hmm
from .performance import Backtest, backtest

DAY = 86_400


def folds(df: DataFrame, days: int = 180) -> DataFrame:
    """series, fold, start, boundary, stop: months that begin ``days`` or more after the first bar.

    A fold trains on [start, boundary) and is judged on [boundary, stop); the last stops an
    hour after the last bar.
    """
    span = df.groupBy("series").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    month = F.explode(F.sequence(F.date_trunc("month", F.timestamp_seconds("first")), F.timestamp_seconds("last"), F.expr("interval 1 month")))
    clock = F.col("first") % DAY
    months = span.withColumn("month", month).select("series", "first", "last", (F.unix_seconds("month") + clock).alias("boundary")).where(F.col("boundary") >= F.col("first") + days * DAY).where("boundary <= last")
    w = Window.partitionBy("series").orderBy("boundary")
    stop = F.coalesce(F.lead("boundary").over(w), F.col("last") + 3600)
    return months.select("series", (F.row_number().over(w) - 1).alias("fold"), (F.col("boundary") - days * DAY).alias("start"), "boundary", stop.alias("stop"))


def fold_rows(df: DataFrame, plan: DataFrame) -> DataFrame:
    """The bars of each fold, marked ``oos`` after the boundary. A bar is in ``days`` / 30 folds or so.

    Joined by series and month, then by time, so that no series meets all its folds at once.
    """
    month = lambda c: F.year(F.timestamp_seconds(c)) * 12 + F.month(F.timestamp_seconds(c))
    spread = plan.withColumn("m", F.explode(F.sequence(month("start"), month("stop"))))
    rows = df.withColumn("m", month("t")).join(spread, ["series", "m"]).where("t >= start and t < stop").drop("m")
    return rows.withColumn("oos", F.col("t") >= F.col("boundary"))


def fold_counts(df: DataFrame, days: int = 180) -> DataFrame:
    rows = fold_rows(df, folds(df, days))
    return rows.groupBy("series", "fold", "boundary").agg(F.sum((~F.col("oos")).cast("long")).alias("train_bars"), F.sum(F.col("oos").cast("long")).alias("oos_bars"))


def walk_forward(df: DataFrame, features: list[str], k: int, days: int = 180, restarts: int = 3, seed: int = 42, ret: str = "ret", **options) -> DataFrame:
    """series, t, fold, state, signal, ret, train_log_lik for the bars after each boundary.

    Scores come from the training bars' states; the signal from a filter that starts anew.
    Each (series, fold) is a group; too short ones give no rows.
    """
    rows = fold_rows(df, folds(df, days)).select("series", "fold", "t", "oos", F.col(ret).alias("r"), *features)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        names = ["series", "t", "fold", "state", "signal", "ret", "train_log_lik"]
        group = group.sort_values("t", kind="stable")
        train, test = group[~group["oos"]], group[group["oos"]]
        if len(train) < max(k, 20) or not len(test):
            return pd.DataFrame({x: [] for x in names})
        x, mean, sd = hmm.standardise(train[features].to_numpy(float))
        fits = hmm.fit_many(x, k, [seed + i for i in range(restarts)], **options)
        if not fits:
            return pd.DataFrame({x: [] for x in names})
        model = max(fits, key=lambda m: m["log_likelihood"]) | {"mean": mean, "sd": sd}
        path = hmm.decode(model, train[features].to_numpy(float))["state"]
        r = train["r"].to_numpy()
        sharpe = [r[path == j].mean() / r[path == j].std(ddof=1) if (path == j).sum() > 1 and r[path == j].std(ddof=1) > 1e-12 else math.nan for j in range(k)]
        known = [s for s in sharpe if not math.isnan(s)]
        filled = [np.median(known) if known and math.isnan(s) else 0.0 if math.isnan(s) else s for s in sharpe]
        score = 2 * np.argsort(np.argsort(filled, kind="stable"), kind="stable") / (k - 1) - 1
        p = hmm.decode(model, test[features].to_numpy(float))["filtered"]
        return pd.DataFrame({"series": test["series"], "t": test["t"], "fold": test["fold"], "state": p.argmax(1), "signal": np.clip(p @ score, -1, 1), "ret": test["r"], "train_log_lik": model["log_likelihood"]})

    return rows.groupBy("series", "fold").applyInPandas(run, "series string, t long, fold int, state int, signal double, ret double, train_log_lik double")


def walk_forward_backtest(df: DataFrame, features: list[str], k: int, config: Backtest | None = None, **options) -> DataFrame:
    """One backtest over all folds' bars."""
    return backtest(walk_forward(df, features, k, **options), config=config)


def fold_summary(rows: DataFrame, ret: str = "ret", bars_per_year: float = 8760.0) -> DataFrame:
    """One row for each fold of :func:`walk_forward`: its first and last bar, bars, return, Sharpe ratio of holding, states met, training likelihood."""
    r = F.col(ret)
    return rows.groupBy("series", "fold").agg(
        F.min("t").alias("first"),
        F.max("t").alias("last"),
        F.count("*").alias("oos_bars"),
        F.count_distinct("state").alias("states"),
        F.avg("signal").alias("mean_signal"),
        (F.exp(F.sum(r)) - 1).alias("total_return"),
        F.when(F.stddev_samp(r) > 1e-12, F.avg(r) / F.stddev_samp(r) * bars_per_year**0.5).alias("sharpe"),
        F.first("train_log_lik").alias("train_log_lik"),
    )
