"""Streams against tables, files, configuration, reports, the whole run."""

import json
import math

import pytest
from pyspark.sql import functions as F

from statewell.operators.features import pipeline
from statewell.plans import config, report, run
from statewell.plans.base import states
from statewell.plans.queries_core import MEANS, SDS, START, TRANS
from statewell.sources.bars import hourly_by_type, read_bars, write_bars
from statewell.streaming.trading import Account, Live, replay, run_stream

LIVE = Live(tuple(START), tuple(map(tuple, TRANS)), tuple(MEANS), tuple(SDS), {0: 0.0, 1: 0.5, 2: 1.0}, warmup=3)


def test_stream_gives_the_rows_of_the_table(spark, sf, tmp_path):
    df = states(spark, sf).select("series", "t", "log_return", "close").persist()
    want = sorted(map(tuple, replay(df, LIVE).collect()))
    cuts = df.approxQuantile("t", [0.3, 0.6], 0.0)
    for i, part in enumerate((df.where(F.col("t") <= cuts[0]), df.where((F.col("t") > cuts[0]) & (F.col("t") <= cuts[1])), df.where(F.col("t") > cuts[1]))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in{i}")
    spark.createDataFrame([], df.schema).write.parquet(f"{tmp_path}/all")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/all")
    for i in range(3):  # a micro-batch each, the last with late bars again
        spark.read.parquet(f"{tmp_path}/in{i}", *([f"{tmp_path}/in0"] if i == 2 else [])).coalesce(1).write.mode("append").parquet(f"{tmp_path}/all")
        q = run_stream(stream, LIVE).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == want


def test_account_survives_saving():
    a, b = Account(LIVE), Account(LIVE)
    for i in range(20):
        b = Account(LIVE, b.save()) if i else b
        assert a.step(i, math.sin(i) * 2, 10.0 + i) == b.step(i, math.sin(i) * 2, 10.0 + i)
    assert a.step(5, 0.0, 1.0) is None


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="close"):
        replay(spark.createDataFrame([], "series string, t long, log_return double"), LIVE)


def test_bars_round_trip(spark, sf, tmp_path):
    df = hourly_by_type(spark, sf)
    write_bars(df, f"{tmp_path}/bars")
    again = read_bars(spark, f"{tmp_path}/bars").select(df.columns)
    assert again.exceptAll(df).count() == 0 and again.count() == df.count()
    with pytest.raises(ValueError, match="no feature"):
        pipeline(df, [("none", {})])


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("asset: {symbol: X}\nfeatures: [{name: log_returns}, {name: rolling_volatility, params: {window: 12}}]\nmodel: {candidate_states: [2, 3], n_restarts: 2}\nselection: {criterion: aic}\n")
    c = config.load(path)
    assert c.criterion == "aic" and c.features[1] == ("rolling_volatility", {"window": 12}) and c.model.n_restarts == 2
    for bad in ("{}", "asset: {symbol: X, period: 800d}", "asset: {symbol: X}\nmodel: {candidate_states: [1]}", "asset: {symbol: X}\nselection: {criterion: x}", "asset: {symbol: X}\nfeatures: [{name: none}]", "asset: {symbol: X, period: 3w}"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            config.load(path)


def test_whole_run(spark, sf, tmp_path):
    write_bars(hourly_by_type(spark, sf).where("series = 'click'"), f"{tmp_path}/bars")
    (tmp_path / "c.yaml").write_text("asset: {symbol: CLICK}\nmodel: {candidate_states: [2], n_restarts: 1, n_iter: 20}\n")
    run.main([f"{tmp_path}/c.yaml", f"{tmp_path}/bars", "--out", f"{tmp_path}/out"])
    got = json.loads((tmp_path / "out/analysis_report.json").read_text())
    assert set(run.PARTS) < set(got) and all(got[p] for p in run.PARTS)
    assert "## state statistics" in (tmp_path / "out/analysis.md").read_text()


def test_commands(spark, sf, tmp_path):
    (tmp_path / "c.yaml").write_text("asset: {symbol: X}\nmodel: {candidate_states: [2], n_restarts: 2, n_iter: 15}\nevaluation: {run_stability: true, stability_n_runs: 2, walk_forward_n_restarts: 1}\n")
    df = hourly_by_type(spark, sf)
    names = sorted(r.series for r in df.select("series").distinct().collect())[:2]
    for name in names:
        write_bars(df.where(F.col("series") == name), f"{tmp_path}/{name}")
        run.main(["run", f"{tmp_path}/c.yaml", f"{tmp_path}/{name}", "--out", f"{tmp_path}/all/{name}", "--span", "5", "--window", "10d", *(["--wf-backtest"] if name == names[0] else [])])
    first = f"{tmp_path}/all/{names[0]}"
    rows = {x: spark.read.parquet(f"{first}/{x}.parquet") for x in ("regimes", "regime_analytics", "signals", "backtest", "stability", "models")}
    assert all(not x.isEmpty() for x in rows.values()) and {"state", "label"} < set(rows["signals"].columns)
    assert {r.label for r in rows["regimes"].select("label").distinct().collect()} <= {"bearish", "bullish"}
    # less than two months of bars leave no fold; the tables are there all the same
    assert spark.read.parquet(f"{first}/wf_fold_summary.parquet").columns[:2] == ["series", "fold"]
    text = "\n".join(r.value for r in spark.read.text(f"{first}/diagnostics").collect())
    assert all(x in text for x in ("Fits", "States", "Statistics", "Transitions", "Dwell times", "Stability"))
    # a saved model decodes to the same states
    run.main(["run", f"{tmp_path}/c.yaml", f"{tmp_path}/{names[0]}", "--out", f"{tmp_path}/again", "--load-model", f"{first}/models.parquet"])
    key = lambda d: sorted(map(tuple, d.select("series", "t", "state").collect()))
    assert key(spark.read.parquet(f"{tmp_path}/again/regimes.parquet")) == key(rows["regimes"])
    run.main(["compare", f"{tmp_path}/all", "--out", f"{tmp_path}/compared", "--daily"])
    got = json.loads((tmp_path / "compared/analysis_report.json").read_text())
    assert len(got["return_corr"]) == 1 and len(got["concordance_matrix"]) == 4 and got["agreement"][0]["series_a"] == f"{names[0]}/{names[0]}"
    run.main(["trade", first, "--out", f"{tmp_path}/traded", "--capital", "5000", "--warmup", "3"])
    account = json.loads((tmp_path / "traded/analysis_report.json").read_text())["accounts"][0]
    last = spark.read.parquet(f"{tmp_path}/traded/account.parquet").orderBy(F.desc("t")).first()
    assert math.isclose(account["equity"], last.equity)
    assert math.isclose(last.equity, 5000 + last.realized + last.unrealized, abs_tol=1e-6)
    assert spark.read.parquet(f"{tmp_path}/traded/fills.parquet").count() > 0


def test_report_without_nan():
    assert json.loads(report.to_json({"a": [math.nan, {"b": math.inf}], "c": 1})) == {"a": [None, {"b": None}], "c": 1}
