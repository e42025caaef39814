"""Streams equal batches on the same events."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leadlake.operators import windows as O
from leadlake.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def drained(q):
    q.processAllAvailable()
    q.stop()


def source(spark, tmp_path, df):
    path = str(tmp_path / "in")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_windowed_counts(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    s = jobs.windowed_counts(source(spark, tmp_path, e.repartition(2)), "ts", "event_type", "value", late="60 days")
    drained(s.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).start())
    want = {tuple(r) for r in jobs.windowed_counts(e, "ts", "event_type", "value").collect()}
    assert {tuple(r) for r in spark.table("counts").collect()} == want


def test_hysteresis(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "ts", "value")
    s = jobs.hysteresis(source(spark, tmp_path, e.coalesce(1)), "event_type", "ts", "value", 40, 10)
    drained(s.writeStream.outputMode("append").format("memory").queryName("flags").option("checkpointLocation", str(tmp_path / "c")).start())
    w = W.partitionBy("event_type").orderBy("ts")
    want = {tuple(r) for r in e.withColumn("paused", O.hysteresis(F.col("value"), 40, 10, w)).collect()}
    assert {tuple(r) for r in spark.table("flags").collect()} == want


def test_locks_and_sink(spark, tmp_path):
    e = spark.createDataFrame([("a", T0), ("a", T0 + dt.timedelta(seconds=10)), ("b", T0)], "k string, ts timestamp")
    s = jobs.first_within(source(spark, tmp_path, e.coalesce(1)), "ts", ["k"], "5 minutes")
    drained(jobs.to_table(s, str(tmp_path / "out"), str(tmp_path / "c")))
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
