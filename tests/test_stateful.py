"""Streams with state equal their batch forms, in any order of micro-batches, over restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from leadlake.operators import states
from leadlake.operators import windows as O
from leadlake.streaming import jobs, stateful

T0 = dt.datetime(2024, 1, 1)


def files(spark, path, chunks, schema):
    """Each chunk as one file, read in this order."""
    import os
    import time

    for i, rows in enumerate(chunks):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{i:03d}")
        for n in os.listdir(f"{path}/{i:03d}"):
            os.utime(f"{path}/{i:03d}/{n}", (time.time() - 1000 + i * 10,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def drained(stream, out, checkpoint, mode="append"):
    q = jobs.to_table(stream, out, checkpoint, mode)
    q.processAllAvailable()
    q.stop()


@pytest.mark.parametrize("seed", [1, 2])
def test_locks_in_any_order_of_batches(spark, tmp_path, seed):
    stateful.prepared(spark)
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), T0 + dt.timedelta(seconds=rng.randint(0, 4000))) for _ in range(120)]
    chunks = [rows[i::5] for i in range(5)]
    rng.shuffle(chunks)
    end = [("z", T0 + dt.timedelta(days=9))]
    schema = "k string, ts timestamp"
    s = stateful.locks(files(spark, str(tmp_path / "in"), [*chunks, end, [("z", T0 + dt.timedelta(days=20))]], schema), "k", "ts", 300, "2 hours")
    drained(s, str(tmp_path / "out"), str(tmp_path / "c"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("k <> 'z'").select("k", "ts").collect()}
    want = {tuple(r) for r in O.ttl_locks(spark.createDataFrame(rows, schema), "k", "ts", 300).select("k", "ts").collect()}
    assert got == want and len(got) > 20


def test_the_tables_last_events_take_their_locks(spark, tmp_path):
    """Watermarks are whole milliseconds: the last event, and those of its millisecond, come out too."""
    from leadlake.plans import catalogue

    at = lambda micros: T0 + dt.timedelta(days=1, microseconds=micros)
    rows = [(1, T0), (1, at(700)), (2, at(701)), (3, at(702)), (3, at(700)), (4, T0), (4, T0 + dt.timedelta(hours=1)), (None, at(702)), (5, None)]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got = sorted((r.user_id or 0, r.ts) for r in catalogue.queries()["user_locks_stream"](spark, str(tmp_path)).collect())
    assert got == [(0, at(702)), (1, T0), (1, at(700)), (2, at(701)), (3, at(700)), (4, T0)]


def test_sessions_over_a_restart(spark, tmp_path):
    stateful.prepared(spark)
    at = lambda h: T0 + dt.timedelta(hours=h)
    schema = "id string, ts timestamp, blocked boolean, verdict string"
    first = [[("free", at(0), False, "VERIFIED"), ("held", at(0), True, "PARTIALLY_VERIFIED"), ("stuck", at(0), True, None), ("late", at(1), True, "VERIFIED")]]
    second = [[("held", at(2), False, None), ("none", at(2), None, None)], [("late", at(40), True, None), ("new", at(60), True, "VERIFIED")], [("end", at(61), False, None)]]
    path = str(tmp_path / "in")
    for stream in (lambda: files(spark, path, first, schema), lambda: _more(spark, path, second, schema)):
        drained(stateful.session_steps(stream(), "id", "ts", 24 * 3600, "0 seconds"), str(tmp_path / "out"), str(tmp_path / "c"))
    rows = spark.read.parquet(str(tmp_path / "out"))
    last = {r.key: (r.after, r.step) for r in rows.groupBy("key").agg(F.max_by("after", "step").alias("after"), F.max("step").alias("step")).collect()}
    everything = spark.createDataFrame([r for c in first + second for r in c], schema)
    want = {r.id: (r.status, r.steps) for r in states.steps(everything, "id", "ts", 24 * 3600, at(61)).collect()}
    assert last == want
    assert want["free"][0] == "POSTGRES_VERIFIED" and want["held"][0] == "PARTIALLY_VERIFIED" and want["stuck"][0] == "NEEDS_REVIEW" and want["new"] == ("PHASE1_BLOCKED", 3)
    assert rows.groupBy("key", "step").count().where("count > 1").isEmpty()


def _more(spark, path, chunks, schema):
    import os
    import time

    for i, rows in enumerate(chunks):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/9{i}")
        for n in os.listdir(f"{path}/9{i}"):
            os.utime(f"{path}/9{i}/{n}", (time.time() - 500 + i * 10,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_rings_and_numbered_batches_over_a_restart(spark, tmp_path):
    stateful.prepared(spark)
    rng = random.Random(4)
    schema = "k long, ts timestamp, id long, value double"
    rows = [(i % 3, T0 + dt.timedelta(seconds=i * 7), i, float(rng.randint(0, 9))) for i in range(400)]
    path = str(tmp_path / "in")
    late = [rows[200:300], rows[0:100]]
    for turn in range(2):
        s = files(spark, path, late, schema) if turn == 0 else _more(spark, path, [rows[300:], rows[100:200]], schema)
        drained(stateful.rings(s, "k", "ts", "id", 20), str(tmp_path / "ring"), str(tmp_path / "rc"), "update")
    got = spark.read.parquet(str(tmp_path / "ring"))
    assert [r.id for r in stateful.newest_of(got, "ts", 20).collect()] == list(range(399, 379, -1))
    one = got.where("key = 1").groupBy("version").agg(F.count(F.lit(1)).alias("n")).orderBy("version").collect()
    assert [r.n for r in one] == [20] * 4
    path = str(tmp_path / "in2")
    for turn in range(2):
        s = files(spark, path, [rows[:90], rows[90:170]], schema) if turn == 0 else _more(spark, path, [rows[170:]], schema)
        drained(stateful.closed_batches(s, "k", "ts", "id", "value", 25), str(tmp_path / "nums"), str(tmp_path / "nc"))
    numbered = jobs.numbered_batches(spark.createDataFrame(rows, schema), ["ts", "id"], "k", 25)
    want = {(r.k, r.batch_no, 25, r.y) for r in numbered.groupBy("k", "batch_no").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("y")).where("n = 25").collect()}
    assert {(r.key, r.batch_no, r.searches, r["yield"]) for r in spark.read.parquet(str(tmp_path / "nums")).collect()} == want and len(want) == 15


@pytest.mark.parametrize("processor", [stateful._Locks(1), stateful._Sessions(1, "AGENT2_QUEUED", 20), stateful._Ring(3), stateful._Numbers(5)])
def test_processors_load_where_the_package_is_absent(processor, tmp_path):
    """The process on the driver that asks a processor for its states gets neither shipped packages nor the driver's path."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    code = "import sys, pickle; pickle.loads(sys.stdin.buffer.read()); assert 'leadlake' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, input=cloudpickle.dumps(processor), check=True, env={**os.environ, "PYTHONPATH": ""})
