"""Operational signals over ordered samples. Each takes a partition key, so that no window gathers the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def sustained(value: Column, least: float, samples: int, w) -> Column:
    """Whether the last samples are all at or above least."""
    last = w.rowsBetween(-(samples - 1), 0)
    return (F.count(value).over(last) == samples) & (F.min(value).over(last) >= least)


def hysteresis(value: Column, high: float, low: float, w) -> Column:
    """On from high, off from low, in between as it was."""
    mark = F.when(value >= high, True).when(value <= low, False)
    return F.coalesce(F.last(mark, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(False))


def circuit_breaker(samples: DataFrame, key: str, ts: str, production_down: str | None = None) -> DataFrame:
    """samples (key, ts, mem, cpu, browsers, queue_depth) with level, can_crawl, can_discover, reason."""
    w = W.partitionBy(key).orderBy(ts)
    cpu = F.col("cpu")
    pressure, paused, emergency = sustained(cpu, 85.0, 2, w), sustained(cpu, 90.0, 3, w), sustained(cpu, 95.0, 2, w)
    full = hysteresis(F.col("queue_depth"), 100, 60, w)
    down = F.col(production_down) if production_down else F.lit(False)
    mem = F.col("mem")
    ladder = [
        (down, "PAUSED", False, False, "PAUSED: DEPENDENCY_UNAVAILABLE"), (mem >= 95, "EMERGENCY", False, False, "EMERGENCY: HIGH_MEMORY"), (emergency, "EMERGENCY", False, False, "EMERGENCY: HIGH_CPU"),
        (mem >= 85, "PAUSED", False, False, "PAUSED: HIGH_MEMORY"), (paused, "PAUSED", False, False, "PAUSED: HIGH_CPU"), (F.col("browsers") > 4, "PAUSED", False, False, "PAUSED: HIGH_BROWSER_COUNT"),
        (full, "PAUSED", True, False, "PAUSED: QUEUE_BACKPRESSURE"), ((mem >= 80) | pressure, "PRESSURE", True, True, "PRESSURE: RESOURCE_WARNING"),
    ]
    out = F.struct(F.lit("NORMAL").alias("level"), F.lit(True).alias("can_crawl"), F.lit(True).alias("can_discover"), F.lit(None).cast("string").alias("reason"))
    for hit, level, crawl, discover, reason in reversed(ladder):
        out = F.when(hit, F.struct(F.lit(level).alias("level"), F.lit(crawl).alias("can_crawl"), F.lit(discover).alias("can_discover"), F.lit(reason).alias("reason"))).otherwise(out)
    return samples.withColumn("_b", out).select(*samples.columns, "_b.*")


def health(level: Column, redis_ok: Column, database_ok: Column, store_ok: Column, search_ok: Column) -> Column:
    return F.when((level == "EMERGENCY") | ~redis_ok | ~database_ok, "unhealthy").when(level.isin("PAUSED", "PRESSURE") | ~store_ok | ~search_ok, "degraded").otherwise("healthy")


def round_robin(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """df with turn: the use's number modulo n."""
    return df.withColumn("turn", F.pmod(F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1, F.lit(n)))


def until_sum(df: DataFrame, key: str, order: list[str], value: str, most: int) -> DataFrame:
    """Rows of each key up to the one at which the running sum reaches most."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("_s", F.coalesce(F.sum(value).over(w), F.lit(0))).where(F.col("_s") < most).drop("_s")


def leases(df: DataFrame, key: str, ts: str, most: int, seconds: int = 90) -> DataFrame:
    """df with granted: fewer than most requests of the key in the seconds before."""
    w = W.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, -1)
    return df.withColumn("granted", F.count(F.lit(1)).over(w) < most)


def ttl_locks(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """df with is_new: no earlier event of the key within the time to live of a lock taken by an accepted event.

    A lock is taken by accepted events alone, so the rows of a key are read in order; one time is carried from row to row, whatever a key's number of events."""
    kind = df.schema[key].dataType.simpleString()
    e = df.where(F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))

    def run(batches):
        import pyarrow as pa

        at_key, free = object(), 0
        for b in batches:
            keep = []
            for k, t in zip(b.column("key").to_pylist(), b.column("at").to_pylist()):
                new = k != at_key or t >= free
                if new:
                    at_key, free = k, t + seconds * 1_000_000
                keep.append(new)
            yield b.filter(pa.array(keep, pa.bool_()))

    taken = e.repartition("key").sortWithinPartitions("key", "at").mapInArrow(run, f"key {kind}, at long")
    return taken.select(F.col("key").alias(key), F.timestamp_micros("at").cast("timestamp_ntz").alias(ts))


def stage_latency(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Milliseconds since the key's previous event."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    before = F.lag(micros).over(W.partitionBy(key).orderBy(ts))
    return df.withColumn("ms", F.round((micros - before) / 1000.0, 1))


def schedule(tasks: DataFrame, queue: str, priority: str, ts: str, key: str) -> DataFrame:
    """tasks with place: high priority first, then first come."""
    return tasks.withColumn("place", F.row_number().over(W.partitionBy(queue).orderBy(F.col(priority).desc(), ts, key)))


def dead_letters(tasks: DataFrame, retries: str, most: int) -> DataFrame:
    return tasks.where(F.col(retries) >= most)
