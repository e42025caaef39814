"""Streams with state over the event table, read as a stream from end to end and written batch by batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.plans.registry import QUERIES, SQL
from leadlake.session import shared_dir, ship
from leadlake.streaming import jobs, stateful


def _streamed(name: str, sql: str, mode: str = "append"):
    """Registers f, which makes a stream of a stream of events; what it wrote is finished by `after`."""

    def put(f: Callable[[DataFrame], DataFrame], after: Callable[[DataFrame], DataFrame] = lambda df: df):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            path = f"{sf_dir}/events.parquet"
            events = stateful.prepared(spark).readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may be of a file or a folder
            stream, at = f(events), f"{shared_dir(spark)}/leadlake-stream-{uuid.uuid4().hex}"
            spark.createDataFrame([], stream.schema).write.parquet(f"{at}/out/batch=-1")
            jobs.to_table(stream, f"{at}/out", f"{at}/checkpoint", mode, all_now=True).awaitTermination()
            return after(spark.read.schema(stream.schema).parquet(f"{at}/out/*"))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name], SQL[name] = run, sql
        return f

    return put


@_streamed("user_locks_stream", """
WITH RECURSIVE r(user_id, ts) AS (SELECT user_id, min(ts) FROM events GROUP BY user_id UNION ALL SELECT r.user_id, min(e.ts) FROM r JOIN events e ON e.user_id = r.user_id AND e.ts >= r.ts + INTERVAL 6 HOUR GROUP BY r.user_id)
SELECT user_id, ts FROM r""")
def user_locks_stream(events):
    """Events that find their user's lock of six hours free and take it, as they are streamed."""
    return stateful.locks(events, "user_id", "ts", 6 * 3600, "0 seconds", whole=True)


def activity_ring_stream(events):
    """The newest 300 events, from rings of sixteen shards of users."""
    return stateful.rings(events.withColumn("shard", F.pmod("user_id", F.lit(16))), "shard", "ts", "event_id", 300)


_streamed("activity_ring_stream", "SELECT ts, event_id AS id FROM events ORDER BY ts DESC, event_id DESC LIMIT 300", "update")(activity_ring_stream, lambda df: stateful.newest_of(df, "ts", 300))


def closed_batches_stream(events):
    """Each user's full batches of 50 searches, evaluated once."""
    return stateful.closed_batches(events, "user_id", "ts", "event_id", "value", 50)


_streamed("closed_batches_stream", """SELECT user_id AS key, (k - 1) // 50 AS batch_no, count(*) AS searches, round(sum(value), 2) AS yield FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
GROUP BY ALL HAVING count(*) = 50""")(closed_batches_stream, lambda df: df.withColumn("yield", F.round("yield", 2)))
