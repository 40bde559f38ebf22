"""The bar format: rows, pruned files, streams."""

from pyspark.sql import functions as F

from statewell.sources import bar_source
from statewell.sources.bars import hourly_by_type, write_bars


def test_bars_by_format(spark, sf, tmp_path):
    bar_source.register(spark)
    df = hourly_by_type(spark, sf)
    path = f"{tmp_path}/bars"
    write_bars(df, path)
    names = sorted(x.series for x in df.select("series").distinct().collect())
    got = spark.read.format("bars").load(path)
    assert got.columns == df.columns
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(got) == key(df)
    one = got.where(F.col("series") == names[0])
    assert key(one) == key(df.where(F.col("series") == names[0]))
    assert one.rdd.getNumPartitions() == 1 < got.rdd.getNumPartitions()
    cut = df.approxQuantile("t", [0.5], 0.0)[0]
    late = got.where((F.col("t") > int(cut)) & F.col("series").isin(names[:2]))
    assert key(late) == key(df.where((F.col("t") > int(cut)) & F.col("series").isin(names[:2])))
    assert got.where("t < 0").rdd.getNumPartitions() <= 1 and got.where("t < 0").isEmpty()


def test_files_of_no_row_of_a_range_are_not_read(spark, sf, tmp_path):
    df = hourly_by_type(spark, sf)
    write_bars(df, f"{tmp_path}/bars")
    reader = bar_source.BarReader(f"{tmp_path}/bars")
    last = df.groupBy("series").agg(F.max("t").alias("t")).collect()
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual

    top = max(r.t for r in last)
    assert list(reader.pushFilters([GreaterThanOrEqual(("t",), top), EqualTo(("close",), 1.0)])) == [EqualTo(("close",), 1.0)]
    assert {x.series for x in reader.partitions()} == {r.series for r in last if r.t == top}


def test_a_stream_reads_each_file_once(spark, sf, tmp_path):
    bar_source.register(spark)
    df, path = hourly_by_type(spark, sf), f"{tmp_path}/bars"
    names = sorted(x.series for x in df.select("series").distinct().collect())
    spark.conf.set("spark.sql.streaming.stateStore.minDeltasForSnapshot", "10")
    for i, name in enumerate(names[:2]):
        df.where(F.col("series") == name).coalesce(1).write.mode("append").partitionBy("series").parquet(path)
        q = spark.readStream.format("bars").load(path).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        got = spark.read.parquet(f"{tmp_path}/out")
        assert sorted(map(tuple, got.select(df.columns).collect())) == sorted(map(tuple, df.where(F.col("series").isin(names[: i + 1])).collect()))
