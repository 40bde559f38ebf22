"""Row numbers, running sums and blocks of long ordered keys, without a window over a whole key."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

#: Bars of a block.
BARS = 4096


def numbered(df: DataFrame, bars: int = BARS) -> DataFrame:
    """``df`` (series, t and more) with n, the number of a row in its series from 0, and block = n div ``bars``.

    Rows are counted in cells of time, about ``bars`` to a cell; what lies before a cell
    is summed over cells, and rows are numbered within one. Equal times come in any order.
    What goes in and what comes out are written once, as each is read several times.
    """
    df = stored(df)
    span = df.groupBy("series").agg(F.min("t").alias("__lo"), F.max("t").alias("__hi"), F.ceil(F.count("*") / bars).alias("__cells"))
    rows = df.join(span, "series").withColumn("__cell", F.expr("(t - __lo) * __cells div (__hi - __lo + 1)")).drop("__lo", "__hi", "__cells")
    counts = rows.groupBy("series", "__cell").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("series").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("series", "__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("series", "__cell").orderBy("t")) - 1
    rows = rows.withColumn("__inside", inside).join(offsets, ["series", "__cell"])
    n = (F.col("__before") + F.col("__inside")).cast("long")
    return stored(rows.withColumn("n", n).withColumn("block", F.expr(f"n div {bars}")).drop("__cell", "__before", "__inside"))


def running(df: DataFrame, keys: list[str], order: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with sums of each row and all before it in its key, and all_* of the whole key.

    Rows are dealt by ranges of (keys, order) and written once, so that every later step
    sees the same ranges; a key of any length spreads over many. Sums before a range come from the
    totals of ranges, which are few; inside one they are a window.
    """
    columns = [F.col(x) if isinstance(x, str) else x for x in order]
    ranged = stored(df.repartitionByRange(*keys, *columns).withColumn("__range", F.spark_partition_id()))
    return _running(ranged, keys, columns, sums)


def _totals(ranged: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    totals = ranged.groupBy(*keys, "__range").agg(*(F.sum(c).alias(f"__{x}") for x, c in sums.items()))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    return totals.select(*keys, "__range", *(f"__{x}" for x in sums), *(F.coalesce(F.sum(f"__{x}").over(before), F.lit(0)).alias(f"__before_{x}") for x in sums), *(F.sum(f"__{x}").over(whole).alias(f"all_{x}") for x in sums))


def _running(ranged: DataFrame, keys: list[str], columns: list[Column], sums: dict[str, Column]) -> DataFrame:
    inside = Window.partitionBy(*keys, "__range").orderBy(*columns).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.select("*", *(F.sum(c).over(inside).alias(x) for x, c in sums.items()))
    totals = _totals(ranged, keys, sums).drop(*(f"__{x}" for x in sums))
    rows = rows.join(totals, [*keys, "__range"])
    for x in sums:
        rows = rows.withColumn(x, F.col(x) + F.col(f"__before_{x}"))
    return rows.drop("__range", *(f"__before_{x}" for x in sums))


def crossing(df: DataFrame, keys: list[str], order: list[str | Column], weight: Column, reached) -> DataFrame:
    """The rows of each key's range in which the running sum of ``weight`` (upto) first meets a condition.

    ``reached(upto, all)`` must stay true once it is. Only the range that crosses is
    sorted, so selecting a quantile of a key costs one pass over its rows.
    """
    columns = [F.col(x) if isinstance(x, str) else x for x in order]
    ranged = stored(df.repartitionByRange(*keys, *columns).withColumn("__range", F.spark_partition_id()))
    totals = _totals(ranged, keys, {"upto": weight})
    at = totals.where(reached(F.col("__before_upto") + F.col("__upto"), F.col("all_upto"))).groupBy(*keys).agg(F.min_by(F.struct("__range", "__before_upto", "all_upto"), "__range").alias("__at"))
    at = at.select(*keys, "__at.*")
    inside = Window.partitionBy(*keys).orderBy(*columns).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.join(at, [*keys, "__range"])
    rows = rows.withColumn("upto", F.sum(weight).over(inside) + F.col("__before_upto"))
    return rows.where(reached(F.col("upto"), F.col("all_upto"))).drop("__range", "__before_upto")


def scan(df: DataFrame, inputs: list[str], outputs: dict[str, str], summary: Callable, link: Callable, fill: Callable, bars: int = BARS) -> DataFrame:
    """series, t and ``outputs`` of a recursion whose passage of a block is a short vector.

    ``summary(*arrays)`` reduces a block's bars to a vector. ``link(vectors)`` gives what enters each
    block of a series, from the vectors of all of them in order. ``fill(entered, *arrays)``
    gives the outputs of a block's bars. Blocks are reduced and filled in tasks of their own; a series
    meets as one vector a block only.
    """
    rows = numbered(df.select("series", "t", *inputs), bars)
    arrays = lambda g: [g[x].to_numpy() for x in inputs]

    def reduce_(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("n")
        return pd.DataFrame({"series": g["series"].iloc[:1], "block": g["block"].iloc[:1], "vector": [np.asarray(summary(*arrays(g)), float).tolist()]})

    def entering(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("block")
        return pd.DataFrame({"series": g["series"], "block": g["block"], "entered": np.asarray(link(np.array(g["vector"].tolist())), float).tolist()})

    def filled(g: pd.DataFrame, head: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("n")
        return pd.DataFrame({"series": g["series"].to_numpy(), "t": g["t"].to_numpy()} | dict(fill(np.asarray(head["entered"].iloc[0]), *arrays(g))), columns=["series", "t", *outputs])

    vectors = rows.groupBy("series", "block").applyInPandas(reduce_, "series string, block long, vector array<double>")
    heads = vectors.groupBy("series").applyInPandas(entering, "series string, block long, entered array<double>")
    schema = "series string, t long, " + ", ".join(f"{k} {v}" for k, v in outputs.items())
    return rows.groupBy("series", "block").cogroup(heads.groupBy("series", "block")).applyInPandas(filled, schema)
