"""Streams with keyed state: exact locks, the session machine, ring buffers, numbered batches. Each equals its batch form, whatever micro-batches
its rows come in and over restarts from the checkpoint, as all that is remembered is in the state.

State lives in RocksDB (`prepared` sets it), a few numbers for each key: one timestamp and the events that still wait for the watermark (locks), a status and a
deadline (sessions), n rows (rings), a counter and a sum (batches). Rows with a null key are a key of their own; null times are left out of locks and rings.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from leadlake.operators.states import FINAL, NEXT

# the process that asks a processor for its states gets no shipped packages: processors travel whole, not by the name of this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the state store that list states and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def _micros(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp")).alias("at")


def _frame(**columns) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series(list(c), dtype=object) for n, c in columns.items()})


class _Locks(StatefulProcessor):
    """Events wait until the watermark has passed them, so they are judged in the order of their times, however they arrive."""

    def __init__(self, micros: int):
        self.micros = micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")
        self.waiting = handle.getListState("waiting", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = [int(t) for df in rows for t in df["at"]]
        self.waiting.appendList([(t,) for t in times])
        self.handle.registerTimer(-(-min(times) // 1000))  # one timer is enough: when it expires, it sets the next
        yield _frame(key=[], at=[])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(r[0] for r in self.waiting.get())
        last, taken = (self.last.get()[0] if self.last.exists() else None), []
        for t in [t for t in waiting if t <= due]:
            if last is None or t - last >= self.micros:
                last = t
                taken.append(t)
        rest = [t for t in waiting if t > due]
        if rest:
            self.waiting.put([(t,) for t in rest])
            self.handle.registerTimer(-(-rest[0] // 1000))
        else:
            self.waiting.clear()
        if last is not None:
            if not rest and due - last > self.micros:
                self.last.clear()  # the lock is over: nothing of the key is kept
            else:
                self.last.update((last,))
                self.handle.registerTimer((last + self.micros) // 1000 + 1)
        if taken:
            yield _frame(key=[key[0]] * len(taken), at=taken)

    def close(self) -> None:
        pass


def locks(events: DataFrame, key: str, ts: str, seconds: int, late: str, whole: bool = False) -> DataFrame:
    """The stream of events that find their key's lock free and take it for `seconds`: windows.ttl_locks, exactly, of rows that come at most `late` after newer
    ones. A row comes out once the watermark has passed it. Watermarks are whole milliseconds, at most the newest time, so rows of the last begun millisecond
    wait for newer ones. whole: all rows come in one micro-batch, no newer ones follow; times are rounded up for the watermark, which passes all of them."""
    kind = events.schema[key].dataType.simpleString()
    e = events.where(F.col(ts).isNotNull()).select(F.col(key).alias("key"), _micros(ts))
    mark = F.col("at") + F.pmod(-F.col("at"), F.lit(1000)) if whole else F.col("at")
    e = e.withColumn("mark", F.timestamp_micros(mark)).withWatermark("mark", late)
    out = e.groupBy("key").transformWithStateInPandas(_Locks(seconds * 1_000_000), f"key {kind}, at long", "Append", "EventTime")
    return out.select(F.col("key").alias(key), F.timestamp_micros("at").cast("timestamp_ntz").alias(ts))


def machine(status: str, blocked: bool, verdict: str | None, most: int = 20) -> list[tuple[str, str]]:
    """The transitions of one run: steps until a final state, a block, or `most` steps."""
    out = []
    for _ in range(most):
        if status in FINAL or (status == "PHASE1_BLOCKED" and blocked):
            break
        if status == "PHASE1_VERIFYING" and blocked:
            to = "PHASE1_BLOCKED"
        elif status == "FINAL_VERIFICATION":
            to = verdict or "NEEDS_REVIEW"
        else:
            to = NEXT.get(status, status)
        if to == status:
            break
        out.append((status, to))
        status = to
    return out


class _Sessions(StatefulProcessor):
    """Runs a session at each of its events; one that stays blocked is carried on when its deadline has passed, by a timer or by its next event."""

    def __init__(self, patience: int, start: str, most: int):
        self.patience, self.start, self.most = patience, start, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "status string, verdict string, deadline long, steps long")

    def _rows(self, key, trace, status, verdict, deadline, steps) -> pd.DataFrame:
        self.state.update((status, verdict, deadline, steps + len(trace)))
        return _frame(key=[key[0]] * len(trace), step=range(steps + 1, steps + len(trace) + 1), before=[a for a, _ in trace], after=[b for _, b in trace])

    def _forced(self, status, verdict):
        return [("PHASE1_BLOCKED", "PHASE1_VERIFIED"), *machine("PHASE1_VERIFIED", False, verdict, self.most)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, verdict, deadline, steps = self.state.get() if self.state.exists() else (self.start, None, -1, 0)
        trace = []
        for at, blocked, said in sorted((int(a), bool(b), v) for df in rows for a, b, v in zip(df["at"], df["blocked"], df["verdict"].astype(object).where(df["verdict"].notna(), ""))):
            if 0 <= deadline <= at:
                trace += self._forced(status, verdict)
                status, deadline = trace[-1][1], -1
            verdict = said or verdict
            more = machine(status, blocked, verdict, self.most)
            trace += more
            status = more[-1][1] if more else status
            if status != "PHASE1_BLOCKED":
                deadline = -1
            elif deadline < 0:
                deadline = at + self.patience
                self.handle.registerTimer(-(-deadline // 1000))
        yield self._rows(key, trace, status, verdict, deadline, steps)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, verdict, deadline, steps = self.state.get()
        if 0 <= deadline <= timerValues.getCurrentWatermarkInMs() * 1000:
            trace = self._forced(status, verdict)
            yield self._rows(key, trace, trace[-1][1], verdict, -1, steps)

    def close(self) -> None:
        pass


def session_steps(events: DataFrame, key: str, ts: str, patience: int, late: str, start: str = "AGENT2_QUEUED", most: int = 20) -> DataFrame:
    """The stream of transitions (key, step, before, after) of sessions whose events (key, ts, blocked, verdict) come in the order of their times, for each
    session. A session that is blocked for `patience` seconds goes on without. The batch form is states.steps."""
    kind = events.schema[key].dataType.simpleString()
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    e = e.select(F.col(key).alias("key"), ts, _micros(ts), F.coalesce("blocked", F.lit(False)).alias("blocked"), "verdict")
    return e.groupBy("key").transformWithStateInPandas(_Sessions(patience * 1_000_000, start, most), f"key {kind}, step long, before string, after string", "Append", "EventTime")


class _Ring(StatefulProcessor):
    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "at long, id long")
        self.version = handle.getValueState("version", "v long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.rows.get()] if self.version.exists() else []
        new = [(int(a), int(i)) for df in rows for a, i in zip(df["at"], df["id"])]
        ring = sorted({*held, *new}, reverse=True)[: self.n]  # a late row finds its place, or is too old
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.rows.put(ring)
        self.version.update((version,))
        yield _frame(key=[key[0]] * len(ring), version=[version] * len(ring), place=range(1, len(ring) + 1), at=[a for a, _ in ring], id=[i for _, i in ring])

    def close(self) -> None:
        pass


def rings(events: DataFrame, key: str, ts: str, id_: str, n: int = 300) -> DataFrame:
    """The newest n events of each key, newest first, after each micro-batch: key, version, place, ts, id. The highest version is the ring. A ring over
    all events takes shards as keys; newest_of merges them."""
    kind = events.schema[key].dataType.simpleString()
    e = events.where(F.col(ts).isNotNull()).select(F.col(key).alias("key"), _micros(ts), F.col(id_).cast("long").alias("id"))
    out = e.groupBy("key").transformWithStateInPandas(_Ring(n), f"key {kind}, version long, place int, at long, id long", "Update", "None")
    return out.select("key", "version", "place", F.timestamp_micros("at").cast("timestamp_ntz").alias(ts), "id")


def newest_of(written: DataFrame, ts: str, n: int = 300) -> DataFrame:
    """Of written rings the newest n events over all keys."""
    last = written.groupBy("key").agg(F.max("version").alias("version"))
    return written.join(last, ["key", "version"]).orderBy(F.col(ts).desc(), F.col("id").desc()).limit(n).select(ts, "id")


class _Numbers(StatefulProcessor):
    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", "seen long, total double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, total = self.state.get() if self.state.exists() else (0, 0.0)
        closed = []
        for _, _, v in sorted((int(a), int(i), float(v)) for df in rows for a, i, v in zip(df["at"], df["id"], df["value"])):
            seen, total = seen + 1, total + v
            if seen % self.size == 0:
                closed.append((seen // self.size - 1, total))
                total = 0.0
        self.state.update((seen, total))
        yield _frame(**{"key": [key[0]] * len(closed), "batch_no": [b for b, _ in closed], "searches": [self.size] * len(closed), "yield": [t for _, t in closed]})

    def close(self) -> None:
        pass


def closed_batches(searches: DataFrame, key: str, ts: str, id_: str, value: str, size: int = 50) -> DataFrame:
    """Evaluations (key, batch_no, searches, yield) of the key's batches of `size` searches, each once, when it is full. Searches count in the order they come."""
    kind = searches.schema[key].dataType.simpleString()
    e = searches.select(F.col(key).alias("key"), _micros(ts), F.col(id_).cast("long").alias("id"), F.coalesce(value, F.lit(0.0)).cast("double").alias("value"))
    return e.groupBy("key").transformWithStateInPandas(_Numbers(size), f"key {kind}, batch_no long, searches long, yield double", "Append", "None")
