"""Weights of series, portfolio returns, execution."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import BARS, scan
from ..functions.posterior import argmax, dot, numbers
from ..functions.rolling import order, rows_before
from .recursions import drawdown_scale


def score_weights(df: DataFrame, score: str = "score", long_only: bool = True) -> DataFrame:
    """Weights in proportion to scores, absolute weights of each time summing to one."""
    raw = F.greatest(F.col(score), F.lit(0.0)) if long_only else F.col(score)
    size = F.sum(F.abs("raw")).over(Window.partitionBy("t"))
    return df.withColumn("raw", raw).withColumn("weight", F.when(size >= 1e-8, F.col("raw") / size).otherwise(F.col("raw"))).drop("raw")


def kelly_weights(df: DataFrame, ret: str = "ret", score: str = "score", fraction: float = 0.25, window: int = 168, least_var: float = 1e-8, long_only: bool = True) -> DataFrame:
    """Mean over variance of the ``window`` bars before, by the sign of the score."""
    frame = rows_before(window)
    f = fraction * F.avg(ret).over(frame) / F.greatest(F.var_samp(ret).over(frame), F.lit(least_var)) * F.signum(score)
    raw = df.withColumn("__k", F.when(F.count(ret).over(frame) >= 2, f).otherwise(0.0))
    return score_weights(raw, "__k", long_only).drop("__k")


def portfolio_returns(df: DataFrame, weight: str = "weight", ret: str = "ret", cost_bps: float = 1.0) -> DataFrame:
    """Net return of each time: yesterday's weights earn, changes cost; the first bar of a series is free."""
    before = F.lag(weight).over(order())
    rows = df.select("t", (F.coalesce(before, F.lit(0.0)) * F.col(ret)).alias("earned"), (F.coalesce(F.abs(F.col(weight) - before), F.lit(0.0)) * cost_bps / 1e4).alias("cost"))
    return rows.groupBy("t").agg((F.sum("earned") - F.sum("cost")).alias("net"))


def vol_target(df: DataFrame, weight: str = "weight", ret: str = "ret", target: float = 0.15, window: int = 168, bars_per_year: float = 8760.0, most: float = 2.0) -> DataFrame:
    """Weights scaled so that the portfolio of the ``window`` bars before has ``target`` volatility.

    With today's weights, w'Cw is the variance of the past rows' weighted sums, so pairs of
    series are summed: each pair meets once a time, and series are few beside bars.
    """
    own = df.select("t", "series", F.col(weight).alias("w"), F.col(ret).alias("x"))
    a, b = own.select("t", F.col("series").alias("i"), F.col("w").alias("wi"), F.col("x").alias("xi")), own.select("t", F.col("series").alias("j"), F.col("w").alias("wj"), F.col("x").alias("xj"))
    frame = Window.partitionBy("i", "j").orderBy("t").rowsBetween(-window, -1)
    pairs = a.join(b, "t").withColumn("c", F.covar_samp("xi", "xj").over(frame)).withColumn("n", F.count("*").over(frame))
    floor = F.when(F.col("i") == F.col("j"), 0.01**2 / bars_per_year).otherwise(0.0)
    c = F.when(F.col("n") >= 2, F.col("c")).otherwise(floor)
    risk = pairs.groupBy("t").agg(F.sum(F.col("wi") * F.col("wj") * c).alias("v"))
    size = own.groupBy("t").agg(F.sum(F.abs("w")).alias("gross"))
    vol = F.sqrt(F.greatest(F.col("v") * bars_per_year, F.lit(1e-12)))
    scale = risk.join(size, "t").select("t", F.when(F.col("gross") < 1e-8, 0.0).otherwise(F.least(target / vol, most / F.col("gross"))).alias("multiplier"))
    return df.join(scale, "t").withColumn("target_weight", F.col(weight) * F.col("multiplier"))


def position_limits(vols: Sequence[float], base: float = 1.0, power: float = 1.0, least: float = 0.0) -> list[float]:
    low = min(vols)
    return [max(base / (v / low) ** power if v > 0 else base, least) for v in vols]


def limited(df: DataFrame, weight: str, limits: Sequence[float]) -> DataFrame:
    """Weights held within the posterior's blend of the states' limits."""
    most = dot(F.col("posterior"), numbers(limits))
    return df.withColumn("limit", most).withColumn("limited", F.greatest(F.least(F.col(weight), F.col("limit")), -F.col("limit")))


def drawdown_budget(sharpes: Sequence[float], total: float = 0.1) -> list[float]:
    s = np.maximum(np.nan_to_num(np.array(sharpes, float)), 0)
    return list(total * s / s.sum()) if s.sum() > 0 else [total / len(s)] * len(s)


def impact_parameters(df: DataFrame, spread: str = "log_hl_range", volume: str = "volume", base: float = 0.1) -> DataFrame:
    """Half spread, impact coefficient and volume of each state, weighted by its probability."""
    x = F.col(spread)
    rows = df.select("series", x.alias("x"), F.col(volume).alias("v"), F.posexplode("posterior").alias("state", "w"))
    m = rows.groupBy("series", "state").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"), (F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("avg_volume"))
    d = rows.join(m, ["series", "state"]).groupBy("series", "state").agg(F.sqrt(F.sum(F.col("w") * F.pow(F.col("x") - F.col("m"), 2)) / F.sum("w")).alias("sd"))
    whole = df.groupBy("series").agg(F.stddev_pop(x).alias("all_sd"))
    out = m.join(d, ["series", "state"]).join(whole, "series")
    return out.select("series", "state", (0.5 * F.abs("m")).alias("half_spread"), (base * (F.col("sd") / (F.col("all_sd") + 1e-10) + 1e-10)).alias("impact"), "avg_volume")


def slippage(size: Column, half_spread: Column, impact: Column, volume: Column) -> Column:
    return half_spread + impact * F.sqrt(F.abs(size) / (volume + 1e-10))


def slippage_attribution(df: DataFrame, parameters: DataFrame, size: str) -> DataFrame:
    """Spread and impact of each bar's order under its posterior, and the likeliest state."""
    ordered = F.array_sort(F.collect_list(F.struct("state", "half_spread", "impact", "avg_volume")))
    p = parameters.groupBy("series").agg(ordered.alias("__p"))
    of = lambda name: dot(F.col("posterior"), F.transform("__p", lambda x: x[name]))
    out = df.join(p, "series").withColumn("spread_cost", of("half_spread")).withColumn("impact_cost", of("impact") * F.sqrt(F.abs(size) / (of("avg_volume") + 1e-10)))
    return out.withColumn("cost", F.col("spread_cost") + F.col("impact_cost")).withColumn("likeliest", argmax(F.col("posterior"))).drop("__p")


def twap(total: float, horizon: int) -> list[float]:
    return [total / horizon] * horizon


def vwap(df: DataFrame, total: float, bucket: Column, volume: str = "volume") -> DataFrame:
    """A share of ``total`` for each bucket in proportion to its mean volume; equal shares without volume."""
    v = df.groupBy("series", bucket.alias("bucket")).agg(F.avg(volume).alias("v"))
    whole = Window.partitionBy("series")
    return v.select("series", "bucket", F.when(F.sum("v").over(whole) > 0, total * F.col("v") / F.sum("v").over(whole)).otherwise(total / F.count("*").over(whole)).alias("size"))


def order_schedule(total: float, horizon: int = 10, urgency: float = 0.5, least: float = 0.01) -> tuple[list[float], int]:
    """Slices of an order that shrink by a constant factor, and the bar at which it is done.

    Slices below a share ``least`` of the order are left to the first one.
    """
    keep = 1 - min(max(urgency, 1e-6), 1 - 1e-6)
    share = keep ** np.arange(horizon)
    share /= share.sum()
    share = np.where(share < least, 0.0, share)
    if share.any():
        share[share.argmax()] += 1 - share.sum()
    done = int(np.searchsorted(share.cumsum(), 0.999))
    return (total * share).tolist(), min(done, horizon - 1)


def schedule_cost(sizes: list[float], half_spread: float, impact: float, volume: float) -> float:
    """Expected slippage of all slices, each by its own size."""
    return sum(abs(x) * (half_spread + impact * (abs(x) / (volume + 1e-10)) ** 0.5) for x in sizes)


def drawdown_controlled(df: DataFrame, weight: str = "weight", ret: str = "ret", bars: int = BARS, **limits: float) -> DataFrame:
    """series, t, weight, scale and scaled: weights cut by the drawdown of the portfolio they make.

    The weights of a bar earn at the next one. Bars are summed over series, and the
    portfolio is followed over blocks of them.
    """
    earned = F.coalesce(F.lag(weight).over(Window.partitionBy("series").orderBy("t")), F.lit(0.0)) * F.col(ret)
    total = df.withColumn("__earned", earned).groupBy("t").agg(F.sum("__earned").alias("x")).withColumn("series", F.lit("portfolio"))
    scale = drawdown_scales(drawdowns(total, "x", bars), bars=bars, **limits).select("t", "scale")
    return df.join(scale, "t").select("series", "t", weight, "scale", (F.col(weight) * F.col("scale")).alias("scaled"))


def drawdowns(df: DataFrame, ret: str, bars: int = BARS) -> DataFrame:
    """series, t, drawdown: share lost since the top of what returns compound to, over blocks of bars."""

    def path(x):
        level = np.cumprod(1 + x)
        return level, np.maximum.accumulate(level)

    def link(parts):
        # growth of a block and its top, both from 1 on, to level and top before each block
        level, top, out = 1.0, -np.inf, []
        for growth, high in parts:
            out.append((level, top))
            top, level = max(top, level * high), level * growth
        return out

    def fill(entered, x):
        level, top = path(x)
        top = np.maximum(top * entered[0], entered[1])
        return {"drawdown": 1 - level * entered[0] / top}

    def summary(x):
        level, top = path(x)
        return level[-1], top[-1]

    return scan(df, [ret], {"drawdown": "double"}, summary, link, fill, bars)


def drawdown_scales(df: DataFrame, bars: int = BARS, **limits: float) -> DataFrame:
    """series, t, scale of drawdowns (series, t, drawdown), over blocks of bars.

    The rule has two states, stopped and not, so a block is a map of two: whether it ends
    stopped, from either.
    """

    def link(parts):
        stopped, out = 0.0, []
        for free, held in parts:
            out.append([stopped])
            stopped = held if stopped else free
        return out

    def fill(entered, d):
        return {"scale": drawdown_scale(d, stopped=bool(entered[0]), **limits)[0]}

    return scan(df, ["drawdown"], {"scale": "double"}, lambda d: [drawdown_scale(d, stopped=x, **limits)[1] for x in (False, True)], link, fill, bars)


# --- mean and variance of few series: small dense matrices, after Spark has summed ---


def box(w: np.ndarray, low: float, high: float) -> np.ndarray:
    """The nearest weights between ``low`` and ``high`` that sum to one; equal ones where no weights do.

    Nearest weights are w less one multiplier, clipped. Their sum falls as the multiplier
    grows, so it is found by bisection.
    """
    n = len(w)
    if not n * low <= 1 <= n * high or not np.isfinite(w).all():
        return np.full(n, 1 / n)
    below, above = w.min() - high, w.max() - low  # all at high, all at low
    for _ in range(200):
        mid = (below + above) / 2
        below, above = (mid, above) if np.clip(w - mid, low, high).sum() > 1 else (below, mid)
    return np.clip(w - (below + above) / 2, low, high)


def min_variance(cov: np.ndarray, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    raw = np.linalg.solve(cov, np.ones(len(cov)))
    return box(raw / raw.sum(), low, high)


def max_sharpe(mean: np.ndarray, cov: np.ndarray, rf: float = 0.0, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    raw = np.linalg.solve(cov, mean - rf)
    return box(raw / raw.sum(), low, high) if raw.sum() > 1e-12 else min_variance(cov, low, high)


def frontier(mean: np.ndarray, cov: np.ndarray, points: int = 30, low: float = 0.0, high: float = 1.0) -> list[tuple[list[float], float, float]]:
    """Weights, volatility and return of blends of the two portfolios above, which all keep to the box."""
    a, b = min_variance(cov, low, high), max_sharpe(mean, cov, 0.0, low, high)
    mixes = [(1 - x) * a + x * b for x in np.linspace(0, 1, points)]
    return [(w.tolist(), float(np.sqrt(w @ cov @ w)), float(w @ mean)) for w in mixes]


def black_litterman(prior: np.ndarray, cov: np.ndarray, views: np.ndarray, confidence: np.ndarray, tau: float = 0.05, posterior: Sequence[float] | None = None) -> np.ndarray:
    """Means between the prior and absolute views, weighted by their precision.

    Confidences are at most 1; ``posterior`` (of states) scales them by its largest
    share, so that views count less where the state is unclear. 0 is no view.
    """
    sure = np.minimum(np.asarray(confidence, float), 1.0)
    if posterior is not None:
        sure = sure * float(np.max(posterior) / (np.sum(posterior) + 1e-15))
    precision = np.linalg.inv(tau * cov + 1e-10 * np.eye(len(prior)))
    return np.linalg.solve(precision + np.diag(sure), precision @ prior + sure * views)


def state_weights(df: DataFrame, columns: list[str], ridge: float = 1e-6) -> DataFrame:
    """series, state, column, min_variance and max_sharpe: weights of ``columns`` as assets, by state and for all bars (-1)."""
    from .dense import by_series, weighted_moments

    rows = df.select("series", *columns, F.posexplode("posterior").alias("state", "w")).unionByName(df.select("series", *columns, F.lit(-1).alias("state"), F.lit(1.0).alias("w")))

    def make(found, weights, mean, cov):
        for k, m, c in zip(found, mean, cov):
            c = c + ridge * np.eye(len(columns))
            yield from ((int(k), name, float(a), float(b)) for name, a, b in zip(columns, min_variance(c), max_sharpe(m, c)))

    return by_series(weighted_moments(rows, columns, ["series", "state"]), make, "state int, column string, min_variance double, max_sharpe double")
