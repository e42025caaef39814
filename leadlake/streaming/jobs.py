"""Continuous forms of the operational signals. Each has a batch twin in operators.windows; the tests hold both against each other."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _marked(events: DataFrame, ts: str, late: str) -> DataFrame:
    """events with a watermark, which wants a time with zone; a batch stays as it is."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events


def windowed_counts(events: DataFrame, ts: str, kind: str, value: str, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Tumbling counts and sums by kind; rows later than the watermark are left out. Works on a batch too."""
    e = _marked(events, ts, late)
    g = e.groupBy(F.window(ts, size).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 2).alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    e = _marked(events, ts, late)
    g = e.groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), user, "n")


def first_within(events: DataFrame, ts: str, keys: list[str], ttl: str) -> DataFrame:
    """One event of each key within the time to live, by the watermark: the approximate form of ttl_locks."""
    return _marked(events, ts, ttl).dropDuplicatesWithinWatermark(keys)


def hysteresis(events: DataFrame, key: str, ts: str, value: str, high: float, low: float) -> DataFrame:
    """key, ts, value, paused: the flag carried from batch to batch in state; one boolean for each key."""
    import pandas as pd

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        on = state.get[0] if state.exists else False
        rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
        flags = []
        for v in rows[value]:
            on = True if v >= high else False if v <= low else on
            flags.append(on)
        state.update((bool(on),))
        yield pd.DataFrame({key: rows[key], ts: rows[ts], value: rows[value], "paused": flags})

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    return events.select(key, ts, value).groupBy(key).applyInPandasWithState(fold, f"{key} {kinds[key]}, {ts} {kinds[ts]}, {value} {kinds[value]}, paused boolean", "paused boolean", "append", "NoTimeout")


def newest(events: DataFrame, ts: str, key: str, n: int = 300) -> DataFrame:
    """The ring buffer of the newest n events, newest first: a top-n, each task keeps n."""
    return events.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n)


def numbered_batches(searches: DataFrame, order: list[str], key: str, size: int = 50) -> DataFrame:
    """searches with batch_no: size searches of a key make a batch."""
    from pyspark.sql import Window as W

    return searches.withColumn("batch_no", F.floor((F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1) / size).cast("int"))


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", all_now: bool = False):
    """Starts a query that writes each micro-batch as a table below path, once: a batch that is written again replaces itself. all_now: it ends after what is there."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}"))
    return (w.trigger(availableNow=True) if all_now else w).start()
