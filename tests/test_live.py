"""Late, shuffled and repeated bars; sinks that a repeated batch leaves as they are."""

import random

import pytest
from pyspark.sql import functions as F

from statewell.plans.base import states
from statewell.plans.queries_core import MEANS, SDS, START, TRANS
from statewell.streaming import sinks
from statewell.streaming.trading import Live, replay, run_live

LIVE = Live(tuple(START), tuple(map(tuple, TRANS)), tuple(MEANS), tuple(SDS), {0: 0.0, 1: 0.5, 2: 1.0}, warmup=3)


def test_a_shuffled_stream_is_a_replay(spark, sf, tmp_path):
    df = states(spark, sf).where("series in ('click', 'purchase', 'view')").select("series", "t", "log_return", "close").persist()
    rows = sorted(map(tuple, df.collect()), key=lambda r: r[1])
    assert rows
    late, rng = 20 * 3600, random.Random(2)
    shuffled = sorted(rows, key=lambda r: r[1] + rng.randrange(late))  # each at most 20 hours behind a newer one
    shuffled += rng.sample(rows[-5:], 3)  # repeated
    flush = max(r[1] for r in rows) + 100 * 3600
    third = len(shuffled) // 3
    parts = [shuffled[:third], shuffled[third : 2 * third], shuffled[2 * third :], [("flush", flush, 0.0, 1.0)], [("flush", flush + 1, 0.0, 1.0)]]
    spark.createDataFrame([], df.schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    got = sinks.LiveSink(f"{tmp_path}/out", channels=[])
    for part in parts:  # a query of its own each time, which goes on from the state of the last
        spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = run_live(stream, LIVE, f"{late} seconds").writeStream.foreachBatch(got).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    want = sorted(map(tuple, replay(df, LIVE).collect()))
    mine = sinks.read_live(spark, f"{tmp_path}/out", "rows").where("series != 'flush'")
    assert sorted(map(tuple, mine.select("series", "t", "state", "confidence", "alert", "position", "equity", "realized").collect())) == want
    ends = {r.series: r.equity for r in sinks.latest_accounts(spark, f"{tmp_path}/out").collect() if r.series != "flush"}
    assert ends == {s: max((w for w in want if w[0] == s), key=lambda w: w[1])[6] for s in {w[0] for w in want}}


def test_a_repeated_batch_writes_and_sends_nothing_twice(spark, tmp_path):
    rows = [("a", 1, 0, 0.9, False, 0.0, 100.0, 0.0), ("a", 2, 1, 0.8, True, 2.0, 101.0, 0.0), ("b", 2, 2, 0.7, True, -1.0, 99.0, 0.5), ("a", 3, 1, 0.8, False, 1.0, 102.0, 0.1)]
    batch = spark.createDataFrame(rows, "series string, t long, state int, confidence double, alert boolean, position double, equity double, realized double")
    sent = []

    def broken(alert):
        raise OSError

    sink = sinks.LiveSink(f"{tmp_path}/live", [broken, sent.append, "log"], {1: "calm", 2: "storm"})
    for _ in range(2):
        sink(batch, 0)
    sink(batch.where("false"), 1)
    assert [(a.series, a.t, a.label) for a in sent] == [("a", 2, "calm"), ("b", 2, "storm")]
    assert sinks.read_live(spark, f"{tmp_path}/live", "rows").count() == 4
    assert sinks.read_live(spark, f"{tmp_path}/live", "alerts").count() == 2
    assert {(r.series, r.t, r.equity) for r in sinks.latest_accounts(spark, f"{tmp_path}/live").collect()} == {("a", 3, 102.0), ("b", 2, 99.0)}
    fills = sorted((r.series, r.t, r.side, r.quantity) for r in sinks.fills_of(batch).collect())
    assert fills == [("a", 2, "buy", 2.0), ("a", 3, "sell", 1.0), ("b", 2, "sell", 1.0)]
    with pytest.raises(KeyError):
        sinks.CHANNELS["none"]
