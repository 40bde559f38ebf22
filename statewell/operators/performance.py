"""Statistics by state, signals from them, and vectorised backtests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import crossing
from ..functions.posterior import argmax, dot
from ..functions.rolling import order, so_far
from .states import run_drawdown

HOURS = 8760.0


def state_stats(df: DataFrame, ret: str = "ret", bars_per_year: float = HOURS) -> DataFrame:
    """Count, weight, annual mean and volatility, tails and win rate of each state."""
    r = F.col(ret)
    whole = Window.partitionBy("series")
    by = df.groupBy("series", "state").agg(
        F.count("*").alias("n"),
        F.avg(r).alias("mean"),
        F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("sd"),
        F.when(F.count(r) >= 3, F.skewness(r)).alias("skewness"),
        F.when(F.count(r) >= 4, F.kurtosis(r)).alias("excess_kurtosis"),
        F.percentile(r, 0.05).alias("var_95"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
    )
    tail = df.join(by.select("series", "state", "var_95"), ["series", "state"]).where(r <= F.col("var_95")).groupBy("series", "state").agg(F.avg(r).alias("cvar_95"))
    vol = F.col("sd") * bars_per_year**0.5
    out = by.withColumn("weight", F.col("n") / F.sum("n").over(whole)).withColumn("mean_return_ann", F.col("mean") * bars_per_year).withColumn("vol_ann", vol)
    out = out.withColumn("sharpe_ann", F.when(F.col("vol_ann") > 1e-12, F.col("mean_return_ann") / F.col("vol_ann")))
    out = out.join(tail, ["series", "state"], "left").join(run_drawdown(df, ret), ["series", "state"], "left")
    return out.select("series", "state", "n", "weight", "mean_return_ann", "vol_ann", "sharpe_ann", "skewness", "excess_kurtosis", "max_drawdown", "var_95", "cvar_95", "win_rate")


def scores(stats: DataFrame, by: str = "sharpe_ann") -> DataFrame:
    """series, state, score: ranks of ``by`` spread over -1 to 1, missing values as the median; 0 for one state."""
    series = Window.partitionBy("series")
    filled = stats.withColumn("v", F.coalesce(by, F.median(by).over(series)))
    rank = F.row_number().over(series.orderBy("v", "state")) - 1
    n = F.count("*").over(series)
    return filled.select("series", "state", F.when(n > 1, 2.0 * rank / (n - 1) - 1).otherwise(0.0).alias("score"))


def average_rank_scores(stats: DataFrame, by: str = "sharpe_ann") -> DataFrame:
    """Like :func:`scores` with missing values as 0 and ties at their mean rank."""
    series = Window.partitionBy("series")
    filled = stats.withColumn("v", F.coalesce(F.col(by), F.lit(0.0)))
    rank = F.rank().over(series.orderBy("v")) + (F.count("*").over(Window.partitionBy("series", "v")) - 1) / 2
    n = F.count("*").over(series)
    return filled.select("series", "state", F.when(n > 1, 2.0 * (rank - 1) / (n - 1) - 1).otherwise(0.0).alias("score"))


def posterior_signal(df: DataFrame, score: DataFrame, clip: bool = True) -> DataFrame:
    """``df`` with signal, the mean score under the posterior. Scores are a row a state."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("state", "score"))), lambda x: x["score"])
    vector = score.groupBy("series").agg(ordered.alias("scores"))
    value = dot(F.col("posterior"), F.col("scores"))
    if clip:
        value = F.greatest(F.least(value, F.lit(1.0)), F.lit(-1.0))
    return df.join(vector, "series").withColumn("signal", value).drop("scores")


@dataclass(frozen=True)
class Backtest:
    mode: str = "proportional"
    threshold: float = 0.25
    cost_bps: float = 1.0
    capital: float = 10_000.0
    bars_per_year: float = HOURS


def position(signal: Column, config: Backtest) -> Column:
    if config.mode == "proportional":
        return F.greatest(F.least(signal, F.lit(1.0)), F.lit(-1.0))
    if config.mode == "threshold":
        return F.when(signal > config.threshold, 1.0).when(signal < -config.threshold, -1.0).otherwise(0.0)
    if config.mode == "long_only":
        return F.greatest(F.least(signal, F.lit(1.0)), F.lit(0.0))
    raise ValueError(f"mode is proportional, threshold or long_only, not {config.mode!r}")


def backtest(df: DataFrame, ret: str = "ret", signal: str = "signal", config: Backtest | None = None) -> DataFrame:
    """``df`` with position, gross, net and equity. A position earns from the next bar on; the first bar costs nothing."""
    config = config or Backtest()
    before = F.lag("position").over(order())
    cost = F.coalesce(F.abs(F.col("position") - before), F.lit(0.0)) * config.cost_bps / 1e4
    out = df.withColumn("position", position(F.col(signal), config))
    out = out.withColumn("gross", F.coalesce(before, F.lit(0.0)) * F.coalesce(F.col(ret), F.lit(0.0)))
    out = out.withColumn("net", F.col("gross") - cost)
    return out.withColumn("equity", config.capital * F.product(1 + F.col("net")).over(so_far()))


def backtest_metrics(result: DataFrame, bars_per_year: float = HOURS) -> DataFrame:
    """One row a series: return, risk and trades of a backtest."""
    top = F.max("equity").over(so_far())
    rows = result.withColumn("dd", (top - F.col("equity")) / top).withColumn("moved", (F.col("position") != F.lag("position").over(order())).cast("int"))
    net = F.col("net")
    m = rows.groupBy("series").agg(
        F.count("*").alias("n"),
        F.min_by("equity", "t").alias("initial"),
        F.max_by("equity", "t").alias("final"),
        F.avg(net).alias("mean"),
        F.stddev_samp(net).alias("sd"),
        F.max("dd").alias("max_drawdown"),
        F.avg(F.when(net != 0, (net > 0).cast("double"))).alias("hit_rate"),
        F.sum(F.when(net > 0, net).otherwise(0.0)).alias("up"),
        F.sum(F.when(net < 0, net).otherwise(0.0)).alias("down"),
        F.coalesce(F.sum("moved"), F.lit(0)).alias("n_trades"),
    )
    m = m.withColumn("total_return", F.col("final") / F.col("initial") - 1)
    m = m.withColumn("cagr", F.when((F.col("initial") > 0) & (F.col("final") > 0), F.pow(F.col("final") / F.col("initial"), bars_per_year / F.col("n")) - 1))
    return m.select(
        "series",
        "total_return",
        "cagr",
        F.when(F.col("sd") > 0, F.col("mean") / F.col("sd") * bars_per_year**0.5).alias("sharpe_ann"),
        "max_drawdown",
        F.when(F.col("max_drawdown") > 0, F.col("cagr") / F.col("max_drawdown")).alias("calmar"),
        "hit_rate",
        F.when(F.col("down") < 0, F.col("up") / F.abs("down")).alias("profit_factor"),
        "n_trades",
        F.when(F.col("n_trades") > 0, F.col("total_return") / F.col("n_trades")).alias("avg_return_per_trade"),
    )


def attribution(df: DataFrame, ret: str = "ret", ann: float = 252.0) -> DataFrame:
    """Performance by state and over all (state null), with one pass of a rollup within each series."""
    r = F.col(ret)
    rows = df.rollup("series", "state").agg(
        F.count("*").alias("n_bars"),
        (F.exp(F.sum(r)) - 1).alias("total_return"),
        (F.stddev_samp(r) * ann**0.5).alias("ann_vol"),
        (F.avg(r) / (F.stddev_samp(r) + 1e-15) * ann**0.5).alias("sharpe"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
    )
    return rows.where("series is not null")


def trades(result: DataFrame, cost: float = 0.001) -> DataFrame:
    """series, t, direction, size and cost of each change of position of a backtest with stops."""
    size = F.abs("trade")
    return result.where(size > 1e-10).select("series", "t", F.signum("trade").cast("int").alias("direction"), size.alias("size"), (size * cost).alias("cost"))


def tearsheet(result: DataFrame, ann: float = 252.0, mar: float = 0.0) -> DataFrame:
    """One row a series: return, risk and trades of a backtest with stops (net, equity from 1, trade).

    sortino is null where no bar is below ``mar``; avg_trade_size is 0 without trades.
    """
    net, size = F.col("net"), F.abs("trade")
    top = F.max("equity").over(so_far())
    m = result.withColumn("dd", (top - F.col("equity")) / (top + 1e-15)).groupBy("series").agg(
        F.max_by("equity", "t").alias("last"),
        F.count("*").alias("n_bars"),
        F.avg(net).alias("mean"),
        F.stddev_samp(net).alias("sd"),
        F.count(F.when(net < mar, net)).alias("n_down"),
        F.coalesce(F.stddev_samp(F.when(net < mar, net)), F.lit(0.0)).alias("down"),
        F.max("dd").alias("max_drawdown"),
        F.avg((net > 0).cast("double")).alias("win_rate"),
        F.count(F.when(size > 1e-10, size)).alias("n_trades"),
        F.coalesce(F.avg(F.when(size > 1e-10, size)), F.lit(0.0)).alias("avg_trade_size"),
    )
    year = F.pow("last", ann / F.col("n_bars")) - 1
    return m.select(
        "series",
        (F.col("last") - 1).alias("total_return"),
        year.alias("ann_return"),
        (F.col("sd") * ann**0.5).alias("ann_vol"),
        (F.col("mean") / (F.col("sd") + 1e-15) * ann**0.5).alias("sharpe"),
        F.when(F.col("n_down") > 0, (F.col("mean") - mar) / (F.col("down") + 1e-15) * ann**0.5).alias("sortino"),
        "max_drawdown",
        (year / (F.col("max_drawdown") + 1e-15)).alias("calmar"),
        "win_rate",
        "n_trades",
        "avg_trade_size",
        "n_bars",
    )


def risk_by_state(df: DataFrame, ret: str = "ret", confidence: float = 0.95, ann: float = HOURS, mar: float = 0.0, least: int = 20) -> DataFrame:
    """Risk of the bars of each state, joined one after another; nulls below ``least`` bars."""
    r = F.col(ret)
    path = Window.partitionBy("series", "state").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("level", F.product(1 + r).over(path))
    rows = rows.withColumn("dd", (F.max("level").over(path) - F.col("level")) / F.max("level").over(path))
    base = rows.groupBy("series", "state").agg(
        F.count("*").alias("n"),
        F.avg(r).alias("mean"),
        F.stddev_samp(r).alias("sd"),
        F.percentile(r, 1 - confidence).alias("q"),
        F.sqrt(F.avg(F.pow(F.least(r - mar, F.lit(0.0)), 2))).alias("down"),
        F.max("dd").alias("max_drawdown"),
    )
    tail = df.join(base.select("series", "state", "q"), ["series", "state"]).where(r <= F.col("q")).groupBy("series", "state").agg((-F.avg(r)).alias("cvar"))
    out = base.join(tail, ["series", "state"], "left")
    known = lambda c: F.when(F.col("n") >= least, c)
    return out.select(
        "series",
        "state",
        "n",
        known(F.col("mean") * ann).alias("mean_ann"),
        known(F.col("sd") * ann**0.5).alias("vol_ann"),
        known(F.when(F.col("sd") * ann**0.5 > 1e-12, F.col("mean") * ann / (F.col("sd") * ann**0.5))).alias("sharpe"),
        known(F.when(F.col("down") >= 1e-12, (F.col("mean") - mar) / F.col("down") * ann**0.5)).alias("sortino"),
        known(-F.col("q")).alias("var"),
        known(F.col("cvar")).alias("cvar"),
        known(F.col("max_drawdown")).alias("max_drawdown"),
        known(F.when(F.col("max_drawdown") > 1e-12, F.col("mean") * ann / F.col("max_drawdown"))).alias("calmar"),
    )


def exploded(df: DataFrame, *columns: str) -> DataFrame:
    """A row for each bar and state, with the state's probability as w."""
    return df.select("series", "t", *columns, F.posexplode("posterior").alias("k", "w"))


def weighted_quantile(rows: DataFrame, value: str, q: float, keys: list[str]) -> DataFrame:
    """The first value at which the summed weight w reaches ``q`` of all, by ``keys``; no row for keys without weight.

    Rows are dealt by ranges of value; only the range that crosses is summed row by row.
    """
    rows = rows.select(*keys, "t", value, "w")
    met = crossing(rows, keys, [value, "t"], F.col("w"), lambda upto, whole: F.try_divide(upto, whole) >= q)
    return met.groupBy(*keys).agg(F.min(value).alias("quantile"))


def weighted_risk(df: DataFrame, ret: str = "ret", confidence: float = 0.95, ann: float = HOURS, mar: float = 0.0, least: float = 20) -> DataFrame:
    """Risk of each state under the posterior as weights; nulls below a weight of ``least``.

    Drawdown and what is divided by it are of the bars whose likeliest state it is.
    """
    keys = ["series", "k"]
    x, w = F.col("x"), F.col("w")
    rows = exploded(df, ret).withColumnRenamed(ret, "x")
    q = weighted_quantile(rows, "x", 1 - confidence, keys)
    m = rows.groupBy(*keys).agg(F.sum("w").alias("eff_n"), F.try_divide(F.sum(w * x), F.sum("w")).alias("mean"))
    sums = rows.join(m.join(q, keys, "left"), keys).groupBy(*keys, "eff_n", "mean", "quantile").agg(
        F.try_divide(F.sum(w * F.pow(x - F.col("mean"), 2)), F.sum("w")).alias("v"),
        F.sqrt(F.try_divide(F.sum(w * F.pow(F.least(x - mar, F.lit(0.0)), 2)), F.sum("w"))).alias("down"),
        F.try_divide(-F.sum(F.when(x <= F.col("quantile"), w * x)), F.sum(F.when(x <= F.col("quantile"), w))).alias("cvar"),
    )
    hard = risk_by_state(df, ret, confidence, ann, mar, int(least)).select("series", F.col("state").alias("k"), "max_drawdown", "calmar")
    out = sums.join(hard, keys, "left")
    vol = F.sqrt("v") * ann**0.5
    known = lambda c: F.when(F.col("eff_n") >= least, c)
    return out.select(
        "series",
        F.col("k").alias("state"),
        "eff_n",
        known(F.col("mean") * ann).alias("mean_ann"),
        known(vol).alias("vol_ann"),
        known(F.when(vol > 1e-12, F.try_divide(F.col("mean") * ann, vol))).alias("sharpe"),
        known(F.when(F.col("down") > 1e-12, F.try_divide(F.col("mean") - mar, F.col("down")) * ann**0.5)).alias("sortino"),
        known(-F.col("quantile")).alias("var"),
        known(F.col("cvar")).alias("cvar"),
        known(F.col("max_drawdown")).alias("max_drawdown"),
        known(F.col("calmar")).alias("calmar"),
    )


def divergence(risk: DataFrame, metrics: tuple[str, ...] = ("mean_ann", "vol_ann", "sharpe", "var", "max_drawdown")) -> DataFrame:
    """Absolute differences of metrics between each two states of a series. States are few."""
    long = risk.unpivot(["series", "state"], list(metrics), "metric", "value")
    a, b = long.alias("a"), long.alias("b")
    pair = (F.col("a.series") == F.col("b.series")) & (F.col("a.metric") == F.col("b.metric")) & (F.col("a.state") < F.col("b.state"))
    return a.join(b, pair).select(F.col("a.series").alias("series"), F.col("a.state").alias("state_a"), F.col("b.state").alias("state_b"), F.col("a.metric").alias("metric"), F.abs(F.col("a.value") - F.col("b.value")).alias("diff"))


def empirical_tails(rows: DataFrame, confidence: float, keys: list[str]) -> DataFrame:
    """var, the loss that weight 1 - ``confidence`` reaches from the largest down, and es, the weighted mean from there on."""
    met = crossing(rows.select(*keys, "t", "loss", "w"), keys, [F.col("loss").desc(), "t"], F.col("w"), lambda upto, whole: upto >= (1 - confidence) * whole - 1e-12)
    var = met.groupBy(*keys).agg(F.max("loss").alias("var_emp"))
    beyond = rows.join(var, keys).where("loss >= var_emp")
    es = beyond.groupBy(*keys).agg((F.sum(F.col("w") * F.col("loss")) / (F.sum("w") + 1e-15)).alias("es_emp"))
    return var.join(es, keys)


def tails(df: DataFrame, ret: str = "ret", threshold_quantile: float = 0.9, confidence: float = 0.99, least: int = 10) -> DataFrame:
    """Generalised Pareto tails of losses by state: moments fit of excesses over a weighted threshold.

    State -1 is the whole series, each bar with weight 1 / bars. Where too little lies
    beyond the threshold, or excesses don't vary, ``var`` and ``es`` are empirical and
    ``fitted`` is false. States without weight have no row.
    """
    losses = df.withColumn("loss", -F.col(ret))
    whole = losses.select("series", "t", "loss", F.lit(-1).alias("k"), (1 / F.count("*").over(Window.partitionBy("series"))).alias("w"))
    rows = exploded(losses, "loss").select("series", "t", "loss", "k", "w").unionByName(whole)
    keys = ["series", "k"]
    u = weighted_quantile(rows, "loss", threshold_quantile, keys).withColumnRenamed("quantile", "threshold")
    eff = rows.groupBy(*keys).agg(F.sum("w").alias("eff_n"))
    over = rows.join(u, keys).where("loss > threshold").withColumn("y", F.col("loss") - F.col("threshold"))
    fit = over.groupBy(*keys).agg(F.avg("y").alias("m"), F.var_pop("y").alias("v"), F.count("*").alias("n_exc"), F.sum("w").alias("w_exc"))
    fits = (F.col("n_exc") >= least) & (F.col("w_exc") >= least) & (F.col("v") >= 1e-15) & (F.col("m") >= 1e-15)
    fit = fit.withColumn("xi0", F.when(fits, 0.5 * (1 - F.try_divide(F.col("m") * F.col("m"), F.col("v")))))
    fit = fit.withColumn("sigma", F.when(fits, F.greatest(F.col("m") * (1 - F.col("xi0")), F.lit(1e-10)))).withColumn("xi", F.when(fits, F.greatest(F.least("xi0", F.lit(2.0)), F.lit(-0.5))))
    out = u.join(eff, keys).join(fit, keys, "left").join(empirical_tails(rows, confidence, keys), keys)
    rho = F.try_divide((1 - confidence) * F.floor("eff_n"), F.floor("w_exc"))
    var = F.col("threshold") + F.when(F.abs("xi") < 1e-6, -F.col("sigma") * F.ln(rho)).otherwise(F.try_divide(F.col("sigma"), F.col("xi")) * (F.pow(rho, -F.col("xi")) - 1))
    out = out.withColumn("gpd", var)
    es = F.when(F.col("xi") < 1, F.try_divide(F.col("gpd") + F.col("sigma") - F.col("xi") * F.col("threshold"), 1 - F.col("xi")))
    return out.select(
        "series",
        F.col("k").alias("state"),
        "threshold",
        "eff_n",
        F.coalesce("n_exc", F.lit(0)).alias("n_exc"),
        "xi",
        "sigma",
        F.coalesce("gpd", "var_emp").alias("var"),
        F.coalesce(es, "es_emp").alias("es"),
        F.col("gpd").isNotNull().alias("fitted"),
    )


def hardest(df: DataFrame) -> DataFrame:
    return df.withColumn("state", argmax(F.col("posterior")))
