"""Result folders, caches, logs."""

import datetime as dt

import pytest

from statewell.sources import results


def test_folders(spark, tmp_path):
    for symbol, sharpe in (("A", [1.0, 2.0]), ("B", [3.0, None])):
        spark.createDataFrame([(i, 0.01 * i, i % 2) for i in range(6)], "t long, ret double, state int").write.parquet(f"{tmp_path}/{symbol}/regimes.parquet")
        spark.createDataFrame(list(enumerate(sharpe)), "state int, sharpe_ann double").write.parquet(f"{tmp_path}/{symbol}/regime_analytics.parquet")
    got = {(r.series, r.state): r.score for r in results.load_results(spark, str(tmp_path)).collect()}
    assert got == {("A", 0): -1, ("A", 1): 1, ("B", 0): 1, ("B", 1): -1}


def test_cache(spark, tmp_path):
    path, made = f"{tmp_path}/{results.cache_name('BTC/USD', '730d', '1h')}", []

    def make():
        made.append(1)
        return spark.range(3)

    assert path.endswith("BTC-USD_730d_1h.parquet")
    assert results.cached(spark, path, make).count() == results.cached(spark, path, make).count() == 3 and len(made) == 1
    assert not results.cache_is_fresh(spark, path, 0)


def test_freshness_and_saved_fills(spark, tmp_path):
    spark.range(1).write.parquet(f"{tmp_path}/x.parquet")
    written = spark._jvm.org.apache.hadoop.fs.Path(f"{tmp_path}/x.parquet")
    at = written.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(written).getModificationTime() / 1000
    assert [results.freshness(spark, f"{tmp_path}/x.parquet", at + s) for s in (5, 130, 7300, 200_000)] == ["0m ago", "2m ago", "2h ago", "2d ago"]
    assert results.freshness(spark, f"{tmp_path}/none") == "no data"
    log = results.fills(spark, [(dt.datetime(2024, 1, 1), "X", "buy", 10.0, 10.0, 0.0, 1.0)])
    for kind in ("parquet", "csv"):
        results.save_fills(log, f"{tmp_path}/{kind}", kind)
        results.save_fills(log, f"{tmp_path}/{kind}", kind)
        assert results.load_fills(spark, f"{tmp_path}/{kind}", kind).collect() == log.collect()


def test_log_and_equity(spark, tmp_path):
    at = [dt.datetime(2024, 1, 1, h) for h in range(3)]
    log = results.fills(spark, [(at[0], "X", "buy", 10.0, 10.0, 0.0, 1.0), (at[1], "X", "sell", 4.0, 12.0, 0.0, 0.0)])
    results.save_fills(log, f"{tmp_path}/p")
    results.save_fills(log, f"{tmp_path}/c", "csv")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2 and spark.read.option("header", True).csv(f"{tmp_path}/c").columns == results.FILL.fieldNames()
    prices = spark.createDataFrame([("X", at[0], 11.0)], "symbol string, timestamp timestamp, price double")
    got = [r.equity for r in results.equity_at_fills(spark.read.parquet(f"{tmp_path}/p"), prices, 1000.0).orderBy("timestamp").collect()]
    assert got == [1000 - 101 + 110, 1000 - 101 + 48 + 72]


def test_joined_inputs(spark):
    a = spark.createDataFrame([("A", 1, 0.1), ("A", 2, 0.2)], "series string, t long, ret double")
    b = spark.createDataFrame([("A", 2, 1.0)], "series string, t long, signal double")
    assert [tuple(r) for r in results.backtest_inputs(a, b).collect()] == [("A", 2, 0.2, 1.0)]
    with pytest.raises(KeyError):
        results.backtest_inputs(a, a)
