"""Windows over a series, in order of time."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F


def order() -> WindowSpec:
    return Window.partitionBy("series").orderBy("t")


def so_far() -> WindowSpec:
    return order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def last_rows(n: int) -> WindowSpec:
    return order().rowsBetween(1 - n, 0)


def rows_before(n: int) -> WindowSpec:
    """The ``n`` rows before this one, without it."""
    return order().rowsBetween(-n, -1)


def rolling(agg, value: str | Column, n: int, least: int | None = None) -> Column:
    """``agg`` over the last ``n`` rows; null while fewer than ``least`` (``n``) have a value."""
    value = F.col(value) if isinstance(value, str) else value
    frame = last_rows(n)
    return F.when(F.count(value).over(frame) >= (n if least is None else least), agg(value).over(frame))


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def zscore(value: str, n: int) -> Column:
    return safe_divide(F.col(value) - rolling(F.avg, value, n), rolling(F.stddev_samp, value, n))


def run_number(state: str = "state") -> Column:
    """Number of the run of equal states that a row is in, within its series."""
    change = F.col(state) != F.lag(state).over(order())
    return F.sum(F.coalesce(change.cast("int"), F.lit(0))).over(so_far())


def drawdown(level: Column) -> Column:
    """Relative distance of a level from its maximum so far, 0 or less."""
    top = F.max(level).over(so_far())
    return (level - top) / (top + 1e-15)
