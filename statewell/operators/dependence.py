"""Dependence between columns by state, and between series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import running
from ..functions.posterior import dot, total
from ..functions.rolling import order, rolling
from ..functions.tables import stored


def weighted_moments(rows: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Weighted means, variances and covariance of x and y by ``keys``; w are weights.

    Two sums: means first, then squares around them, as sums of squares alone lose digits.
    """
    w, a, b = F.col("w"), F.col(x), F.col(y)
    m = rows.groupBy(*keys).agg(F.sum(w).alias("sw"), (F.sum(w * a) / F.sum(w)).alias("mx"), (F.sum(w * b) / F.sum(w)).alias("my"))
    dx, dy = a - F.col("mx"), b - F.col("my")
    return rows.join(m, keys).groupBy(*keys).agg(
        F.first("sw").alias("eff_n"),
        F.first("mx").alias("mx"),
        F.first("my").alias("my"),
        (F.sum(w * dx * dx) / F.first("sw")).alias("vx"),
        (F.sum(w * dy * dy) / F.first("sw")).alias("vy"),
        (F.sum(w * dx * dy) / F.first("sw")).alias("cxy"),
    )


def correlation(moments: DataFrame) -> DataFrame:
    scale = F.sqrt("vx") * F.sqrt("vy")
    return moments.withColumn("corr", F.when(scale > 1e-15, F.col("cxy") / scale).otherwise(0.0))


def weighted_rows(df: DataFrame, *columns: str, least: float = 20.0) -> DataFrame:
    """A row for each bar and state; states of too little weight get equal weights, -1 is all bars."""
    rows = df.select("series", "t", *columns, F.posexplode("posterior").alias("k", "w"))
    eff = F.sum("w").over(Window.partitionBy("series", "k"))
    rows = rows.withColumn("w", F.when(eff < least, F.lit(1.0)).otherwise(F.col("w")))
    return rows.unionByName(df.select("series", "t", *columns, F.lit(-1).alias("k"), F.lit(1.0).alias("w")))


def state_correlation(df: DataFrame, x: str, y: str, method: str = "pearson") -> DataFrame:
    """Weighted correlation of two columns by state."""
    rows = weighted_rows(df, x, y)
    if method == "spearman":
        rows = running(rows, ["series", "k"], [x, "t"], {"rx": F.col("w")})
        rows = running(rows, ["series", "k"], [y, "t"], {"ry": F.col("w")})
        rank = lambda r: (F.col(r) - F.col("w") / 2) / F.col(f"all_{r}")
        rows = rows.select("series", "t", "k", "w", rank("rx").alias(x), rank("ry").alias(y))
    return correlation(weighted_moments(rows, x, y, ["series", "k"])).select("series", F.col("k").alias("state"), "eff_n", "corr")


def concordant(rank: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums of w_i * w_j over pairs i < j with rank[i] < rank[j], for each column of ``w``.

    Sorted halves are merged, all of one width at once: a row of a right half meets the
    running weight of the left rows that rank below it.
    """
    n, at, out, width = len(rank), np.arange(len(rank)), np.zeros(w.shape[1]), 1
    while width < n:
        pair = at // (2 * width)
        order = np.lexsort((rank, pair))
        left = (at[order] // width % 2 == 0)[:, None]
        below = np.cumsum(np.where(left, w[order], 0.0), 0)
        head = np.flatnonzero(np.r_[True, np.diff(pair[order]) > 0])
        base = np.vstack([np.zeros(w.shape[1]), below])[head]
        below -= np.repeat(base, np.diff(np.r_[head, n]), 0)
        out += np.where(left, 0.0, w[order] * below).sum(0)
        width *= 2
    return out


def kendall(df: DataFrame, x: str, y: str, least: int = 4096) -> DataFrame:
    """Weighted Kendall concordance of each state: sum of w_i w_j sign(dx) sign(dy) over sum of w_i w_j, over all pairs of bars.

    No pair is made. Bars get strict ranks in x (ties by y, then t) and in y (ties by x,
    then t), in which every tied pair counts as concordant, so what ties add is known from
    sums over equal values. Ranks are cut in blocks of at least ``least`` bars, about the cube root of the bars
    many. Concordant pairs within a block of x, and within a block of y, are counted by merging
    sorted halves in one task each; those that differ in both blocks come from the
    grid of summed weights.
    """
    columns = ["series", "t", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), "posterior"]
    a = running(df.select(*columns), ["series"], ["x", "y", "t"], {"rx": F.lit(1)})
    a = running(a, ["series"], ["y", "x", "t"], {"ry": F.lit(1)})
    size = F.greatest(F.lit(least), F.ceil(F.col("all_rx") / F.ceil(F.cbrt("all_rx")))).cast("long")
    block = lambda r: F.floor((F.col(r) - 1) / size).alias(r.replace("r", "b"))
    rows = stored(a.select("series", "x", "y", "posterior", "rx", "ry", block("rx"), block("ry")))
    long = rows.select("series", "x", "y", "bx", "by", F.posexplode("posterior").alias("state", "w"))
    kind = "series string, state int, c double"

    def counted(series: str, sums: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"series": series, "state": range(len(sums)), "c": sums})

    def in_x(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rx")
        return counted(g["series"].iloc[0], concordant(g["ry"].to_numpy(), np.array(g["posterior"].tolist())))

    def in_y(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rx")
        w = np.array(g["posterior"].tolist())
        both = concordant(g["ry"].to_numpy(), w)
        for at in g.groupby("bx").indices.values():  # counted within a block of x
            both = both - concordant(g["ry"].to_numpy()[at], w[at])
        return counted(g["series"].iloc[0], both)

    def grid(g: pd.DataFrame) -> pd.DataFrame:
        w = np.zeros((g["bx"].max() + 1, g["by"].max() + 1))
        w[g["bx"], g["by"]] = g["w"]
        below = np.zeros_like(w)
        below[1:, 1:] = w.cumsum(0).cumsum(1)[:-1, :-1]
        return pd.DataFrame({"series": g["series"].iloc[:1], "state": g["state"].iloc[:1], "c": [(w * below).sum()]})

    cells = long.groupBy("series", "state", "bx", "by").agg(F.sum("w").alias("w"))
    counts = rows.groupBy("series", "bx").applyInPandas(in_x, kind).unionByName(rows.groupBy("series", "by").applyInPandas(in_y, kind)).unionByName(cells.groupBy("series", "state").applyInPandas(grid, kind))
    counts = counts.groupBy("series", "state").agg(F.sum("c").alias("c"))

    def pairs_of(*by: str) -> DataFrame:
        """Sum of w_i w_j over pairs with equal values of ``by``."""
        name = f"p_{'_'.join(by)}"
        groups = long.groupBy("series", "state", *by).agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q"))
        return groups.groupBy("series", "state").agg((F.sum(F.col("s") * F.col("s") - F.col("q")) / 2).alias(name))

    for p in (pairs_of(), pairs_of("x"), pairs_of("y"), pairs_of("x", "y")):
        counts = counts.join(p, ["series", "state"])
    tied = F.col("p_x") + F.col("p_y") - F.col("p_x_y")
    return counts.select("series", "state", F.try_divide(2 * F.col("c") - F.col("p_") - tied, F.col("p_")).alias("tau"))


def blended_correlation(df: DataFrame, by_state: DataFrame) -> DataFrame:
    """``df`` with dcc: the states' correlations, weighted by each bar's posterior."""
    vector = by_state.where("state >= 0").groupBy("series").agg(F.transform(F.array_sort(F.collect_list(F.struct("state", "corr"))), lambda x: x["corr"]).alias("__c"))
    return df.join(vector, "series").withColumn("dcc", dot(F.col("posterior"), F.col("__c"))).drop("__c")


def breakdown(df: DataFrame, column: str = "dcc", window: int = 20) -> DataFrame:
    """Rolling deviation of the size of the blended correlation."""
    return df.withColumn("breakdown", rolling(F.stddev_samp, F.abs(column), window, 2))


def tail_dependence(df: DataFrame, x: str, y: str, q: float = 0.1) -> DataFrame:
    """Weighted share of bars with both columns in a tail among those with ``y`` in it, by state."""
    ranked = running(df.select("series", "t", x, y, "posterior"), ["series"], [x, "t"], {"u": F.lit(1)})
    ranked = running(ranked, ["series"], [y, "t"], {"v": F.lit(1)})
    share_of = lambda r: (F.col(r) / (F.col(f"all_{r}") + 1)).alias(r)
    rows = ranked.select("series", share_of("u"), share_of("v"), F.posexplode("posterior").alias("state", "w"))

    def share(a: Column, b: Column) -> Column:
        return F.sum(F.when(a & b, F.col("w")).otherwise(0.0)) / F.greatest(F.sum(F.when(b, F.col("w")).otherwise(0.0)), F.lit(1e-15))

    low = share(F.col("u") <= q, F.col("v") <= q)
    high = share(F.col("u") >= 1 - q, F.col("v") >= 1 - q)
    return rows.groupBy("series", "state").agg(low.alias("lower_tail"), high.alias("upper_tail"))


def hedge(df: DataFrame, y: str, x: str) -> DataFrame:
    """Weighted regression y = alpha + beta x by state (-1: all bars)."""
    m = weighted_moments(weighted_rows(df, x, y), x, y, ["series", "k"])
    beta = F.col("cxy") / (F.col("vx") + 1e-15)
    return m.select("series", F.col("k").alias("state"), "eff_n", beta.alias("beta"), (F.col("my") - beta * F.col("mx")).alias("alpha"))


def half_life(df: DataFrame, spread: str) -> DataFrame:
    """Half-life of a mean-reverting column: null where it doesn't revert."""
    before = F.lag(spread).over(order())
    rows = df.select("series", (F.col(spread) - before).alias("d"), before.alias("s")).where("s is not null")
    fit = rows.groupBy("series").agg(F.regr_slope("d", "s").alias("b"), F.count("*").alias("n"))
    return fit.select("series", "b", mean_reversion(F.col("b"), F.col("n")).alias("half_life"))


def mean_reversion(b: Column, bars: Column) -> Column:
    """Half-life of a spread whose change is ``b`` times its level; null where it doesn't revert."""
    reverts = (bars >= 2) & (b < 0) & (b > -2) & (F.abs(1 + b) > 1e-15)
    return F.when(reverts, -F.ln(F.lit(2.0)) / F.ln(F.abs(1 + b)))


def state_spreads(df: DataFrame, y: str, x: str, least: float = 20.0, most: float = 1000.0) -> DataFrame:
    """The spread y - alpha - beta x of each state (-1: all bars), and how fast it reverts.

    series, state, eff_n, alpha, beta, spread_mean, spread_sd, half_life and eigenvalue, the
    larger one of the weighted covariance of changes of y and x. A state of less weight than ``least`` has
    the regression and half-life of all bars; half-lives are ``most`` at most, and where nothing reverts.
    """
    keys = ["series", "state"]
    step = order()
    own = df.select("series", "t", F.col(y).alias("y"), F.col(x).alias("x"), "posterior", (F.col(y) - F.lag(y).over(step)).alias("dy"), (F.col(x) - F.lag(x).over(step)).alias("dx"), F.lag(y).over(step).alias("y1"), F.lag(x).over(step).alias("x1"))
    whole = total(F.col("posterior")) + 1e-15
    rows = own.select("*", F.posexplode(F.array_append(F.transform("posterior", lambda p: p / whole), F.lit(1.0))).alias("k", "w"))
    rows = stored(rows.withColumn("state", F.when(F.col("k") == F.size("posterior"), -1).otherwise(F.col("k"))).drop("k", "posterior"))
    of_all = lambda c: F.max(F.when(F.col("state") == -1, F.col(c))).over(Window.partitionBy("series"))
    m = weighted_moments(rows, "x", "y", keys)
    slope = F.col("cxy") / (F.col("vx") + 1e-15)
    fits = m.select(*keys, "eff_n", slope.alias("beta"), (F.col("my") - slope * F.col("mx")).alias("alpha"))
    few = (F.col("state") >= 0) & (F.col("eff_n") < least)
    fits = stored(fits.select(*keys, "eff_n", *(F.when(few, of_all(c)).otherwise(F.col(c)).alias(c) for c in ("alpha", "beta"))))
    rows = rows.join(fits, keys)
    spread = lambda a, b: F.col(a) - F.col("alpha") - F.col("beta") * F.col(b)
    rows = rows.withColumn("s", spread("y", "x")).withColumn("s1", spread("y1", "x1"))
    known = F.col("dy").isNotNull()
    w, weight = F.col("w"), F.greatest(F.first("eff_n"), F.lit(1.0))
    mean = rows.groupBy(*keys).agg((F.sum(w * F.col("s")) / weight).alias("spread_mean"), F.regr_slope(F.col("s") - F.col("s1"), F.col("s1")).alias("b"), F.count("s1").alias("bars"))
    spread_of = rows.join(mean.select(*keys, "spread_mean"), keys).groupBy(*keys).agg(F.sqrt(F.sum(w * F.pow(F.col("s") - F.col("spread_mean"), 2)) / weight).alias("spread_sd"))
    moves = weighted_moments(rows.where(known).select(*keys, "w", "dx", "dy"), "dx", "dy", keys)
    half = (F.col("vx") + F.col("vy")) / 2
    eigen = moves.select(*keys, (half + F.sqrt(F.pow((F.col("vx") - F.col("vy")) / 2, 2) + F.pow("cxy", 2)) + 1e-10).alias("eigenvalue"))
    out = fits.join(mean, keys).join(spread_of, keys).join(eigen, keys).withColumn("half_life", mean_reversion(F.col("b"), F.col("bars")))
    own_life = F.when(few, of_all("half_life")).otherwise(F.col("half_life"))
    return out.select(*keys, "eff_n", "alpha", "beta", "spread_mean", "spread_sd", F.least(F.coalesce(own_life, F.lit(most)), F.lit(most)).alias("half_life"), "eigenvalue")


def spread_zscore(df: DataFrame, spread: str, window: int = 20) -> DataFrame:
    mean, sd = rolling(F.avg, spread, window, 2), rolling(F.stddev_samp, spread, window, 2)
    return df.withColumn("zscore", (F.col(spread) - mean) / (sd + 1e-15))


def state_spread_zscore(df: DataFrame, spread: str) -> DataFrame:
    """Distance of a spread from its states' blended mean, in their blended deviations."""
    rows = df.select("series", "t", F.col(spread).alias("s"), F.posexplode("posterior").alias("k", "w"))
    m = rows.groupBy("series", "k").agg((F.sum(F.col("w") * F.col("s")) / F.sum("w")).alias("m"))
    v = rows.join(m, ["series", "k"]).groupBy("series", "k").agg(F.first("m").alias("m"), F.sqrt(F.sum(F.col("w") * F.pow(F.col("s") - F.col("m"), 2)) / F.sum("w")).alias("sd"))
    ordered = F.array_sort(F.collect_list(F.struct("k", "m", "sd")))
    params = v.groupBy("series").agg(ordered.alias("__p"))
    mean = dot(F.col("posterior"), F.transform("__p", lambda x: x["m"]))
    sd = dot(F.col("posterior"), F.transform("__p", lambda x: x["sd"]))
    return df.join(params, "series").withColumn("zscore", (F.col(spread) - mean) / (sd + 1e-15)).drop("__p")


def pairs(df: DataFrame, *columns: str) -> DataFrame:
    """Rows of each two series (a < b) at times all series have. Series are few beside bars."""
    every = df.agg(F.count_distinct("series").alias("n"))  # one row
    common = df.groupBy("t").agg(F.count_distinct("series").alias("n")).join(F.broadcast(every), "n").select("t")
    rows = df.select("series", "t", *columns).join(common, "t", "left_semi")
    a = rows.select("t", F.col("series").alias("series_a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    b = rows.select("t", F.col("series").alias("series_b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return a.join(b, "t").where("series_a < series_b")


def _corr(x: str, y: str) -> Column:
    """Correlation, null where a column is constant (ANSI division raises there)."""
    return F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.covar_pop(x, y) / (F.stddev_pop(x) * F.stddev_pop(y)))


def cross_correlation(p: DataFrame, column: str) -> DataFrame:
    return p.groupBy("series_a", "series_b").agg(_corr(f"{column}_a", f"{column}_b").alias("corr"), F.count("*").alias("n"))


def conditional_correlation(p: DataFrame, column: str, score: str = "score", least: int = 10) -> DataFrame:
    """Correlation of each two series by the directions of their scores; also how often these meet."""
    up = lambda c: F.when(F.col(c) > 0, "bull").otherwise("bear")
    by = p.withColumn("dir_a", up(f"{score}_a")).withColumn("dir_b", up(f"{score}_b")).groupBy("series_a", "series_b", "dir_a", "dir_b")
    return by.agg(F.count("*").alias("n"), F.when(F.count("*") >= least, _corr(f"{column}_a", f"{column}_b")).alias("corr"))


def agreement(p: DataFrame, score: str = "score") -> DataFrame:
    same = ((F.col(f"{score}_a") > 0) == (F.col(f"{score}_b") > 0)).cast("double")
    return p.groupBy("series_a", "series_b").agg(F.avg(same).alias("agreement"), _corr(f"{score}_a", f"{score}_b").alias("score_corr"))


def agreement_matrix(p: DataFrame, score: str = "score") -> DataFrame:
    """series_a, series_b, agreement in both orders with 1 on the diagonal, and overall, the mean over pairs."""
    of = agreement(p, score).select("series_a", "series_b", "agreement")
    names = of.select(F.explode(F.array("series_a", "series_b")).alias("series_a")).distinct()
    whole = of.unionByName(of.select(F.col("series_b").alias("series_a"), F.col("series_a").alias("series_b"), "agreement"))
    whole = whole.unionByName(names.select("series_a", F.col("series_a").alias("series_b"), F.lit(1.0).alias("agreement")))
    overall = of.agg(F.avg("agreement").alias("overall")).withColumn("__one", F.lit(1))  # one row
    return whole.withColumn("__one", F.lit(1)).join(F.broadcast(overall), "__one").drop("__one")


def rolling_agreement(p: DataFrame, score: str = "score", window: int = 20) -> DataFrame:
    same = ((F.col(f"{score}_a") > 0) == (F.col(f"{score}_b") > 0)).cast("double")
    frame = Window.partitionBy("series_a", "series_b").orderBy("t").rowsBetween(1 - window, 0)
    return p.select("series_a", "series_b", "t", F.when(F.count("*").over(frame) == window, F.avg(same).over(frame)).alias("agreement"))


def lead_lag(p: DataFrame, score: str = "score", most: int = 10) -> DataFrame:
    """The shift of series a against b with the largest correlation of directions; the first of ties.

    Each row meets the ``2 * most + 1`` rows it is shifted to, by row number.
    """
    n = F.row_number().over(Window.partitionBy("series_a", "series_b").orderBy("t"))
    rows = p.select("series_a", "series_b", n.alias("n"), (F.col(f"{score}_a") > 0).cast("double").alias("a"), (F.col(f"{score}_b") > 0).cast("double").alias("b"))
    shifted = rows.select("series_a", "series_b", "a", F.explode(F.sequence(F.lit(-most), F.lit(most))).alias("lag"), "n").withColumn("m", F.col("n") - F.col("lag"))
    other = rows.select("series_a", "series_b", F.col("n").alias("m"), "b")
    by = shifted.join(other, ["series_a", "series_b", "m"]).groupBy("series_a", "series_b", "lag").agg(F.coalesce(_corr("a", "b"), F.lit(0.0)).alias("corr"), F.count("*").alias("n")).where("n >= 2")
    best = F.max_by(F.struct("lag", "corr"), F.struct(F.round("corr", 12), -F.col("lag")))
    return by.groupBy("series_a", "series_b").agg(best.alias("best")).select("series_a", "series_b", "best.lag", "best.corr")


def correlation_stability(correlations: DataFrame) -> DataFrame:
    """Mean distance (Frobenius) between the 2 x 2 correlation matrices of each two states of a series."""
    a = correlations.where("state >= 0").select("series", F.col("state").alias("i"), F.col("corr").alias("x"))
    b = a.toDF("series", "j", "y")
    return a.join(b, "series").where("i < j").groupBy("series").agg(F.avg(F.sqrt(F.lit(2.0)) * F.abs(F.col("x") - F.col("y"))).alias("stability"))
