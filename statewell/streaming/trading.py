"""Live decoding, alerts and paper trading: one stateful processor, keyed by series.

The same step runs over a stream (Structured Streaming state) and over a table (one
group a series), so both give the same rows. Bars at or before the last one seen of
their series are dropped, as late or repeated ones are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.fold import fold
from ..operators.recursions import Book, alerts, gaussian_log_density, online_filter

OUT = T.StructType(
    [
        T.StructField("series", T.StringType()),
        T.StructField("t", T.LongType()),
        T.StructField("state", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("alert", T.BooleanType()),
        T.StructField("position", T.DoubleType()),
        T.StructField("equity", T.DoubleType()),
        T.StructField("realized", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class Live:
    """Fixed model of one feature and the rules of trading."""

    start: tuple[float, ...]
    trans: tuple[tuple[float, ...], ...]
    means: tuple[float, ...]
    sds: tuple[float, ...]
    weights: dict[int, float] = field(default_factory=dict)
    feature: str = "log_return"
    warmup: int = 0
    sure: float = 0.6
    cooldown: int = 3
    least_change: float = 0.01
    cash: float = 100_000.0
    slippage_bps: float = 5.0


class Account:
    """What is carried from bar to bar, as JSON between batches."""

    def __init__(self, config: Live, saved: str | None = None) -> None:
        self.config = config
        s = json.loads(saved) if saved else {}
        self.log_alpha = np.array(s["log_alpha"]) if s else None
        self.last, self.seen, self.prev = s.get("last"), s.get("seen", 0), s.get("prev")
        self.since, self.fired, self.held = s.get("since", 0), s.get("fired", False), s.get("held")
        self.book = Book(config.cash, config.slippage_bps)
        for k in ("cash", "position", "average", "realized", "trades"):
            if s:
                setattr(self.book, k, s[k])

    def save(self) -> str:
        b = self.book
        return json.dumps({"log_alpha": self.log_alpha.tolist(), "last": self.last, "seen": self.seen, "prev": self.prev, "since": self.since, "fired": self.fired, "held": self.held, "cash": b.cash, "position": b.position, "average": b.average, "realized": b.realized, "trades": b.trades})

    def step(self, t: int, x: float, price: float) -> tuple | None:
        c = self.config
        if self.last is not None and t <= self.last:
            return None
        self.last, self.seen = t, self.seen + 1
        log_b = gaussian_log_density(np.array([x]), np.array(c.means), np.array(c.sds))
        p = online_filter(log_b, np.array(c.start), np.array(c.trans), self.log_alpha)[0]
        self.log_alpha = np.log(np.maximum(p, 1e-300))
        k = int(p.argmax())
        if self.seen <= c.warmup:
            return (t, k, float(p[k]), False, self.book.position, self.book.value(price), self.book.realized)
        self.since += 1
        alert = self.prev is not None and k != self.prev and p[k] >= c.sure and (not self.fired or self.since > c.cooldown)
        if alert:
            self.since, self.fired = 0, True
        weight = c.weights.get(k, 0.0)
        if self.held is None or abs(weight - self.held) > c.least_change:
            self.book.trade_to(self.book.value(price) * weight / price, price)
        self.held, self.prev = weight, k
        return (t, k, float(p[k]), bool(alert), self.book.position, self.book.value(price), self.book.realized)


def _steps(account: Account, series: str, frame: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for t, x, price in frame.sort_values("t", kind="stable")[["t", account.config.feature, "close"]].itertuples(index=False):
        out = account.step(int(t), float(x), float(price))
        if out is not None:
            rows.append((series, *out))
    return pd.DataFrame(rows, columns=OUT.fieldNames())


class _Processor(StatefulProcessor):
    def __init__(self, config: Live) -> None:
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("account", "saved string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        saved = self.state.get()
        account = Account(self.config, saved[0] if saved is not None else None)
        out = _steps(account, key[0], pd.concat(list(rows)))
        if account.last is not None:
            self.state.update((account.save(),))
        yield out

    def close(self) -> None:
        pass


def _check(df: DataFrame, config: Live) -> None:
    missing = {"series", "t", "close", config.feature} - set(df.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")


def run_stream(bars: DataFrame, config: Live) -> DataFrame:
    """Decoded bars, alerts and account of a stream of (series, t, feature, close).

    Needs the RocksDB state store provider. A micro-batch's bars are put in order of time.
    """
    _check(bars, config)
    return bars.groupBy("series").transformWithStateInPandas(_Processor(config), OUT, "Append", "None")


class _Ordered(StatefulProcessor):
    """Holds bars back until the watermark has passed them, and steps through them in order of time."""

    def __init__(self, config: Live) -> None:
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("account", "saved string")
        self.held = handle.getMapState("held", "t long", "x double, price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for t, x, price in frame[["t", self.config.feature, "close"]].itertuples(index=False):
                if not self.held.containsKey((int(t),)):  # of bars of one time the first that came counts
                    self.held.updateValue((int(t),), (float(x), float(price)))
                    self.handle.registerTimer(int(t) * 1000)
        yield pd.DataFrame(columns=OUT.fieldNames())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted(t for (t,) in self.held.keys() if t * 1000 <= passed)
        if due:
            saved = self.state.get()
            account = Account(self.config, saved[0] if saved is not None else None)
            frame = pd.DataFrame([(t, *self.held.getValue((t,))) for t in due], columns=["t", self.config.feature, "close"])
            out = _steps(account, key[0], frame)
            for t in due:
                self.held.removeKey((t,))
            self.state.update((account.save(),))
            yield out
        else:
            yield pd.DataFrame(columns=OUT.fieldNames())

    def close(self) -> None:
        pass


def run_live(bars: DataFrame, config: Live, late: str = "2 hours") -> DataFrame:
    """Like :func:`run_stream` for bars that come in any order, up to ``late`` behind the newest one.

    Bars wait in state, by time, until the watermark has passed them; an event-time timer lets them
    go in order, so a shuffled stream gives the rows of :func:`replay`. Repeated bars are dropped, and
    those that come later than the watermark. Bars of the last ``late`` wait for newer ones.
    """
    _check(bars, config)
    timed = bars.select("series", "t", config.feature, "close", F.timestamp_seconds("t").alias("ts")).withWatermark("ts", late)
    once = timed.dropDuplicatesWithinWatermark(["series", "t"])
    return once.groupBy("series").transformWithStateInPandas(_Ordered(config), OUT, "Append", "EventTime")


def replay(bars: DataFrame, config: Live) -> DataFrame:
    """The same over a table."""
    _check(bars, config)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return _steps(Account(config), group["series"].iloc[0], group)

    return bars.select("series", "t", config.feature, "close").groupBy("series").applyInPandas(run, OUT)


def replay_decoded(bars: DataFrame, rules: DataFrame, warmup: int = 0, sure: float = 0.6, cooldown: int = 3, **account) -> DataFrame:
    """Account and alerts over decoded bars (series, t, close, state, posterior) under ``rules`` (series, state, weight).

    Like the other columns of :func:`replay`, and unrealized: what the position would earn if it were closed.
    """
    weights = rules.groupBy("series").agg(F.map_from_entries(F.collect_list(F.struct("state", "weight"))).alias("__w"))
    rows = bars.join(weights, "series").select("series", "t", "close", "state", F.coalesce(F.col("__w")[F.col("state")], F.lit(0.0)).alias("weight"), "posterior")

    def run(price, state, weight, posterior):
        alert = np.zeros(len(state), bool)
        alert[warmup:] = alerts(state[warmup:], posterior[warmup:], sure, cooldown)
        book, held = Book(**account), None
        out = {k: np.zeros(len(price)) for k in ("position", "equity", "realized", "unrealized")}
        for i, (px, w) in enumerate(zip(price, weight)):
            if i >= warmup and (held is None or w != held):
                book.trade_to(book.value(px) * w / px, px)
                held = w
            row = (book.position, book.value(px), book.realized, book.position * (px - book.average))
            for name, value in zip(out, row):
                out[name][i] = value
        return {"state": state, "confidence": posterior[np.arange(len(state)), state], "alert": alert, **out}

    return fold(rows, run, ["close", "state", "weight", "posterior"], {"state": "int", "confidence": "double", "alert": "boolean", "position": "double", "equity": "double", "realized": "double", "unrealized": "double"})
