"""Commands: ``run`` (bars to results and a report), ``compare`` (results of several assets), ``trade`` (replay of rules).

All tables are Parquet folders that Spark writes; only what a report shows is collected.
"""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fold import fold
from ..operators import dependence, factors, hmm, performance, portfolio, recursions, semi_markov, stability, states, walk_forward
from ..operators.features import DEFAULT, pipeline
from ..sources import results
from ..sources.bars import read_bars
from ..streaming import sinks, trading
from . import config as conf
from . import report

log = logging.getLogger(__name__)


def feature_frame(bars: DataFrame, config: conf.Config) -> tuple[DataFrame, list[str]]:
    """Features, the return (``ret``) and range of each bar, and the names of those that models use."""
    frame = pipeline(bars, config.features or DEFAULT).withColumn("ret", F.col("log_return"))
    if "log_hl_range" not in frame.columns:
        frame = frame.withColumn("log_hl_range", F.ln(F.col("high") / F.col("low")))
    return frame, [c for c in frame.columns if c.startswith(("log_return", "volatility", "smoothed"))]


def options_of(config: conf.Config) -> dict:
    m = config.model
    return {"covariance": m.covariance_type, "emission": m.emission_dist, "init": m.init_strategy, "n_iter": m.n_iter}


def fit_and_decode(bars: DataFrame, config: conf.Config, saved: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Models of all series, and their bars with state, label and posterior (causal).

    ``saved`` are models of an earlier run, which are then not fitted again.
    """
    frame, names = feature_frame(bars, config)
    m = config.model
    models = (saved if saved is not None else hmm.train(frame, names, m.candidate_states, m.n_restarts, m.seed_base, config.criterion, **options_of(config))).persist()
    decoded = hmm.apply_models(frame, models, names).withColumnRenamed("filtered", "posterior")
    decoded = frame.join(decoded, ["series", "t"])
    label = states.labels(decoded).select("series", "state", "label", "volatility_rank")
    return models, decoded.join(label, ["series", "state"])


#: The parts of a report: a name and what makes its rows from decoded bars.
PARTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "state_statistics": lambda df: performance.state_stats(df),
    "transitions": states.transition_matrix,
    "dwell_times": states.dwell_times,
    "durations": semi_markov.fit_durations,
    "risk": lambda df: performance.risk_by_state(df),
    "weighted_risk": lambda df: performance.weighted_risk(df),
    "tails": lambda df: performance.tails(df),
    "correlation": lambda df: dependence.state_correlation(df, "log_return", "volatility_w24"),
    "concordance": lambda df: dependence.kendall(df, "log_return", "volatility_w24"),
    "tail_dependence": lambda df: dependence.tail_dependence(df, "log_return", "volatility_w24"),
    "execution": lambda df: portfolio.impact_parameters(df),
    "attribution": lambda df: performance.attribution(df),
    "factors": lambda df: factors.by_series(df, ["log_return", "volatility_w24"], 2),
    "cointegration": lambda df: dependence.state_spreads(df, "volatility_w24", "log_return"),
    "portfolio": lambda df: portfolio.state_weights(df, ["log_return", "volatility_w24"]),
    "filtering": lambda df: filtering(df),
    "prediction": lambda df: prediction(df),
    "tearsheet": lambda df: performance.tearsheet(rule_backtest(df)),
}


def filtering(df: DataFrame) -> DataFrame:
    """How much smoothing by state takes from returns: deviations before and after, and of the difference."""

    def run(x, p):
        return {"ret": x, "smooth": recursions.ema(x, recursions.state_alpha(p, [5.0 * 2**k for k in range(p.shape[1])]))}

    rows = fold(df, run, ["ret", "posterior"], {"ret": "double", "smooth": "double"})
    return rows.groupBy("series").agg(F.stddev_samp("ret").alias("raw_sd"), F.stddev_samp("smooth").alias("smooth_sd"), F.stddev_samp(F.col("ret") - F.col("smooth")).alias("removed_sd"), F.corr("ret", "smooth").alias("correlation"))


def prediction(df: DataFrame) -> DataFrame:
    """Of each series: where it stands, how likely it stays there, and the entropy of its next state by what followed so far."""
    now = states.current_state(df).select("series", "t", "state", "run_length")
    moves = states.transition_matrix(df)
    ahead = moves.groupBy("series", "state").agg(F.max(F.when(F.col("state") == F.col("to"), F.col("p"))).alias("stays"), F.max_by("to", "p").alias("likeliest_next"), (-F.sum(F.col("p") * F.ln("p"))).alias("entropy"))
    return now.join(ahead, ["series", "state"], "left")


def rules(stats: DataFrame) -> DataFrame:
    """series, state, weight: all of the account in the state of the best Sharpe ratio, none in the worst, half in others."""
    from pyspark.sql import Window

    value, series = F.coalesce("sharpe_ann", F.lit(0.0)), Window.partitionBy("series")
    up, down = F.row_number().over(series.orderBy(value.desc(), "state")), F.row_number().over(series.orderBy(value, "state"))
    return stats.select("series", "state", F.when(up == 1, 1.0).when(down == 1, 0.0).otherwise(0.5).alias("weight"))


def rule_backtest(df: DataFrame, stop: float = 0.05, take: float = 0.1, cost: float = 0.001) -> DataFrame:
    """Backtest with stops of the rules that the states' own Sharpe ratios give."""
    weights = rules(performance.state_stats(df)).groupBy("series").agg(F.map_from_entries(F.collect_list(F.struct("state", "weight"))).alias("__w"))
    rows = df.join(weights, "series").withColumn("__target", F.col("__w")[F.col("state")])

    def run(ret, target):
        of, state = np.unique(target, return_inverse=True)
        return recursions.stop_backtest(ret, state, of.tolist(), [stop] * len(of), [take] * len(of), cost)

    return fold(rows, run, ["ret", "__target"], {"equity": "double", "net": "double", "position": "double", "trade": "double"})


def analyse(decoded: DataFrame, symbol: str, parts: list[str] | None = None) -> dict:
    """A report; a part that fails is None and logged."""
    out: dict = {"symbol": symbol}
    for name in parts or PARTS:
        try:
            out[name] = report.table(PARTS[name](decoded))
        except Exception:  # a report is worth having without one part
            log.exception("part %s failed", name)
            out[name] = None
    return out


def diagnostics(models: DataFrame, decoded: DataFrame, stats: DataFrame, extra: dict[str, DataFrame]) -> DataFrame:
    """series and a text about its fits, states and transitions, put together by Spark."""

    def lines(rows: DataFrame, title: str, by: list[str]) -> DataFrame:
        show = [F.format_string("%s=%s", F.lit(c), F.coalesce((F.format_number(F.col(c), 6) if t == "double" else F.col(c).cast("string")), F.lit("-"))) for c, t in rows.dtypes if c != "series"]
        text = F.concat(F.lit("  "), F.concat_ws("  ", *show))
        of = rows.select("series", F.struct(*by, text.alias("__text")).alias("__row")).groupBy("series").agg(F.array_sort(F.collect_list("__row")).alias("__rows"))
        return of.select("series", F.concat(F.lit(f"{title}\n"), F.array_join(F.transform("__rows", lambda x: x["__text"]), "\n")).alias("text"))

    parts = [
        lines(models.select("series", "k", "log_likelihood", "aic", "bic", "converged", "finite_restarts", "chosen"), "Fits", ["k"]),
        lines(states.labels(decoded).select("series", "state", "label", "mean", "volatility_rank"), "States", ["state"]),
        lines(stats, "Statistics", ["state"]),
        lines(states.transition_matrix(decoded), "Transitions", ["state", "to"]),
        lines(states.dwell_times(decoded), "Dwell times", ["state"]),
        *(lines(df, name, [c for c in ("fold", "mean_ari") if c in df.columns]) for name, df in extra.items()),
    ]
    rows = parts[0].withColumn("part", F.lit(0))
    for i, part in enumerate(parts[1:], 1):
        rows = rows.unionByName(part.withColumn("part", F.lit(i)))
    texts = F.array_sort(F.collect_list(F.struct("part", "text")))
    return rows.groupBy("series").agg(texts.alias("x")).select("series", F.concat_ws("\n\n", F.lit(None).cast("string"), F.transform("x", lambda p: p["text"])).alias("text"))


def run(args: argparse.Namespace) -> None:
    """regimes, regime_analytics, models, signals, backtest, diagnostics and a report; on demand stability and walk-forward."""
    config = conf.load(args.config)
    out = (args.out or config.output_dir).format(symbol=config.asset.symbol)
    if args.states:
        config.model.candidate_states = [args.states]
    spark = SparkSession.builder.getOrCreate()
    bars = read_bars(spark, args.bars)

    def save(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}.parquet")
        return spark.read.parquet(f"{out}/{name}.parquet")

    saved = spark.read.parquet(args.load_model) if args.load_model else None
    models, decoded = fit_and_decode(bars, config, saved)
    models = save(models, "models") if saved is None else models
    decoded = save(decoded, "regimes")
    label = states.labels(decoded).select("series", "state", "label")
    stats = save(performance.state_stats(decoded).join(label, ["series", "state"]), "regime_analytics")
    score = performance.average_rank_scores(stats) if args.scoring == "average_rank" else performance.scores(stats)
    signal = performance.posterior_signal(decoded, score)
    if args.span:
        smooth = fold(signal, lambda x: {"smooth": recursions.ema(x, 2 / (args.span + 1))}, ["signal"], {"smooth": "double"})
        signal = signal.join(smooth, ["series", "t"]).withColumn("signal", F.col("smooth")).drop("smooth")
    signal = save(signal.select("series", "t", "ret", "signal", "state", "label"), "signals")
    settings = performance.Backtest(mode=args.mode, cost_bps=args.cost_bps)
    result = save(performance.backtest(signal, config=settings), "backtest")
    found = analyse(decoded, config.asset.symbol) | {"backtest": report.table(performance.backtest_metrics(result))}
    frame, names = feature_frame(bars, config)
    e, extra = config.evaluation, {}
    chosen = [r.k for r in models.where("chosen").select("k").distinct().orderBy("k").collect()]  # state counts, which are few
    if args.stability or e.run_stability:
        each = [stability.across_seeds(_of_count(frame, models, k), names, k, e.stability_n_runs, config.model.n_restarts, config.model.seed_base, **options_of(config)) for k in chosen]
        extra["Stability"] = save(_union(each), "stability")
    if args.walk_forward or args.wf_backtest or e.run_walk_forward:
        days = conf.days(args.window or e.walk_forward_train_window)
        each = [walk_forward.walk_forward(_of_count(frame, models, k), names, k, days, e.walk_forward_n_restarts, config.model.seed_base, **options_of(config)) for k in chosen]
        oos = save(_union(each), "walk_forward_regimes")
        extra["Walk forward"] = save(walk_forward.fold_summary(oos), "wf_fold_summary")
        if args.wf_backtest:
            tested = save(performance.backtest(oos, config=settings), "wf_backtest")
            found["walk_forward_backtest"] = report.table(performance.backtest_metrics(tested))
    diagnostics(models, decoded, stats, extra).write.mode("overwrite").partitionBy("series").text(f"{out}/diagnostics")
    report.save(found, out)


def _of_count(frame: DataFrame, models: DataFrame, k: int) -> DataFrame:
    """Bars of the series whose chosen model has ``k`` states."""
    return frame.join(models.where(F.col("chosen") & (F.col("k") == k)).select("series"), "series", "left_semi")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def compare(args: argparse.Namespace) -> None:
    """How assets move together, from what ``run`` left for each: tables, and a text of the pairs."""
    spark = SparkSession.builder.getOrCreate()
    rows = results.load_results(spark, args.results.rstrip("/")).select("series", "t", "ret", "score")
    if args.daily:
        day = (F.col("t") - F.col("t") % 86_400).alias("t")
        rows = rows.groupBy("series", day).agg(F.sum("ret").alias("ret"), F.max_by("score", F.col("t")).alias("score"))
    rows.write.mode("overwrite").parquet(f"{args.out}/aligned_bars.parquet")
    rows = spark.read.parquet(f"{args.out}/aligned_bars.parquet")
    p = dependence.pairs(rows, "ret", "score")
    found = {
        "return_corr": dependence.cross_correlation(p, "ret"),
        "score_corr": dependence.cross_correlation(p, "score"),
        "aligned": p,
        "cond_return_corr": dependence.conditional_correlation(p, "ret"),
        "co_occurrence": dependence.conditional_correlation(p, "ret").select("series_a", "series_b", "dir_a", "dir_b", "n"),
        "agreement": dependence.agreement(p),
        "lead_lag": dependence.lead_lag(p),
        "concordance_matrix": dependence.agreement_matrix(p),
    }
    for name, df in found.items():
        df.write.mode("overwrite").parquet(f"{args.out}/{name}.parquet")
    shown = {x: report.table(spark.read.parquet(f"{args.out}/{x}.parquet")) for x in found if x != "aligned"}
    report.save({"symbol": "comparison"} | shown, args.out)


def trade(args: argparse.Namespace) -> None:
    """Replays the rules of a run's statistics over its decoded bars: accounts, fills and alerts as tables."""
    spark = SparkSession.builder.getOrCreate()
    bars, stats = (spark.read.parquet(f"{args.results.rstrip('/')}/{x}.parquet") for x in ("regimes", "regime_analytics"))
    account = {"cash": args.capital, "slippage_bps": args.slippage_bps}
    rows = trading.replay_decoded(bars, rules(stats), args.warmup, **account)
    rows.write.mode("overwrite").parquet(f"{args.out}/account.parquet")
    rows = spark.read.parquet(f"{args.out}/account.parquet")
    sinks.fills_of(rows, args.slippage_bps).write.mode("overwrite").parquet(f"{args.out}/fills.parquet")
    sinks.alert_records(rows).write.mode("overwrite").parquet(f"{args.out}/alerts.parquet")
    last = rows.groupBy("series").agg(F.max_by(F.struct("t", "state", "position", "equity", "realized", "unrealized"), "t").alias("s")).select("series", "s.*")
    report.save({"symbol": "trade", "accounts": report.table(last)}, args.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="statewell")
    commands = top.add_subparsers(required=True)
    one = commands.add_parser("run", help="fit, decode, backtest and report")
    one.add_argument("config")
    one.add_argument("bars", help="a Parquet table of bars")
    one.add_argument("--out")
    one.add_argument("--states", type=int, help="this many states, whatever the configuration says")
    one.add_argument("--load-model", help="models.parquet of an earlier run")
    one.add_argument("--scoring", choices=["rank", "average_rank"], default="rank")
    one.add_argument("--span", type=int, help="bars of the signal's exponential average")
    one.add_argument("--mode", choices=["proportional", "threshold", "long_only"], default="proportional")
    one.add_argument("--cost-bps", type=float, default=1.0)
    one.add_argument("--stability", action="store_true")
    one.add_argument("--walk-forward", action="store_true")
    one.add_argument("--wf-backtest", action="store_true")
    one.add_argument("--window", help="days to train on, such as 180d")
    one.set_defaults(command=run)
    two = commands.add_parser("compare", help="several assets' results")
    two.add_argument("results", help="the folder with a folder of results for each asset")
    two.add_argument("--out", required=True)
    two.add_argument("--daily", action="store_true", help="compare by days")
    two.set_defaults(command=compare)
    three = commands.add_parser("trade", help="replay a run's rules")
    three.add_argument("results", help="the folder of a run")
    three.add_argument("--out", required=True)
    three.add_argument("--capital", type=float, default=100_000.0)
    three.add_argument("--slippage-bps", type=float, default=5.0)
    three.add_argument("--warmup", type=int, default=0)
    three.set_defaults(command=trade)
    return top


def main(argv: list[str] | None = None) -> None:
    import sys

    argv = sys.argv[1:] if argv is None else argv
    if argv and argv[0] not in ("run", "compare", "trade", "-h", "--help"):
        argv = ["run", *argv]
    args = parser().parse_args(argv)
    args.command(args)


if __name__ == "__main__":
    main()
