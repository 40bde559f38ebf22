"""Features of bars; each is a function from bars to bars with one column more."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import order, rolling, safe_divide, zscore

Transform = Callable[[DataFrame], DataFrame]


def log_returns() -> Transform:
    return lambda df: df.withColumn("log_return", F.ln(safe_divide(F.col("close"), F.lag("close").over(order()))))


def smoothed_returns(window: int = 12) -> Transform:
    return lambda df: df.withColumn(f"smoothed_return_w{window}", rolling(F.avg, "log_return", window))


def rolling_volatility(window: int = 24) -> Transform:
    return lambda df: df.withColumn(f"volatility_w{window}", rolling(F.stddev_samp, "log_return", window))


def log_volume() -> Transform:
    return lambda df: df.withColumn("log_volume", F.log1p(F.greatest(F.col("volume"), F.lit(0.0))))


def volume_zscore(window: int = 24) -> Transform:
    return lambda df: df.withColumn(f"volume_zscore_w{window}", zscore("log_volume", window))


def log_range() -> Transform:
    return lambda df: df.withColumn("log_hl_range", F.ln(F.col("high") / F.col("low")))


FEATURES: dict[str, Callable[..., Transform]] = {
    "log_returns": log_returns,
    "smoothed_returns": smoothed_returns,
    "rolling_volatility": rolling_volatility,
    "log_volume": log_volume,
    "volume_zscore": volume_zscore,
    "log_range": log_range,
}


def pipeline(bars: DataFrame, features: list[tuple[str, dict]]) -> DataFrame:
    """All features in order, then only rows that have every column."""
    for name, options in features:
        if name not in FEATURES:
            raise ValueError(f"no feature is called {name!r}; there are {sorted(FEATURES)}")
        bars = bars.transform(FEATURES[name](**options))
    return bars.na.drop()


DEFAULT = [("log_returns", {}), ("rolling_volatility", {"window": 24}), ("smoothed_returns", {"window": 12}), ("log_volume", {}), ("volume_zscore", {"window": 24}), ("log_range", {})]
