"""Queries over the event stream: the operational signals in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leadlake.functions import text as X
from leadlake.operators import relational as J
from leadlake.operators import scores as S
from leadlake.operators import windows as O
from leadlake.plans.registry import query
from leadlake.streaming import jobs

_K = "CAST(json_extract(props, '$.k') AS INTEGER)"


def _k():
    return F.get_json_object("props", "$.k").cast("int")


@query("events_hourly", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def events_hourly(t):
    """Tumbling windows by type, as the streaming job makes them."""
    return jobs.windowed_counts(t("events"), "ts", "event_type", "value")


@query(
    "event_sessions",
    """WITH a AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM b GROUP BY user_id, s""",
)
def event_sessions(t):
    return jobs.sessions(t("events"), "ts", "user_id").select("user_id", "start", "end", "n")


@query("event_types", "SELECT count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'signup') AS signups, count(*) FILTER (WHERE value >= 50) AS large, count(*) AS total FROM events")
def event_types(t):
    """Predicate buckets in one pass."""
    e = F.col("event_type")
    return J.buckets(t("events"), errors=e == "error", signups=e == "signup", large=F.col("value") >= 50)


@query("status_counts", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def status_counts(t):
    return t("events").groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("latest_event", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_event(t):
    """Latest per key, by a partial aggregation of structs."""
    return J.latest_by(t("events").select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("first_events", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def first_events(t):
    return t("events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("activity_stream", "SELECT event_id, user_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 300")
def activity_stream(t):
    """The ring buffer of the newest 300 events (its size is the feature)."""
    return jobs.newest(t("events"), "ts", "event_id").select("event_id", "user_id", "event_type", "value")


@query("failure_stream", "SELECT event_id, user_id, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 30")
def failure_stream(t):
    return jobs.newest(t("events").where("event_type = 'error'"), "ts", "event_id", 30).select("event_id", "user_id", "value")


@query("stage_latency", "SELECT event_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000.0, 1) AS ms FROM events")
def stage_latency(t):
    return O.stage_latency(t("events"), "user_id", "ts").select("event_id", "ms")


@query(
    "backpressure",
    """WITH a AS (SELECT *, CASE WHEN value >= 40 THEN true WHEN value <= 10 THEN false END AS mark FROM events)
SELECT event_id, user_id, value, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), false) AS paused FROM a""",
)
def backpressure(t):
    """Hysteresis: paused from 40 on, free from 10 down, between as before."""
    w = W.partitionBy("user_id").orderBy("ts")
    return t("events").select("event_id", "user_id", "value", O.hysteresis(F.col("value"), 40, 10, w).alias("paused"))


@query(
    "circuit_breaker",
    f"""WITH s AS (SELECT event_id, user_id, ts, least(100.0, value) AS mem, CAST({_K} AS DOUBLE) AS cpu, event_id % 6 AS browsers, {_K} + 20 AS queue_depth FROM events),
a AS (SELECT *, min(cpu) OVER w2 >= 85 AND count(*) OVER w2 = 2 AS pressure, min(cpu) OVER w3 >= 90 AND count(*) OVER w3 = 3 AS paused, min(cpu) OVER w2 >= 95 AND count(*) OVER w2 = 2 AS emergency,
  coalesce(last_value(CASE WHEN queue_depth >= 100 THEN true WHEN queue_depth <= 60 THEN false END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), false) AS full_queue FROM s
  WINDOW w2 AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), w3 AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT event_id, CASE WHEN mem >= 95 OR emergency THEN 'EMERGENCY' WHEN mem >= 85 OR paused OR browsers > 4 OR full_queue THEN 'PAUSED' WHEN mem >= 80 OR pressure THEN 'PRESSURE' ELSE 'NORMAL' END AS level FROM a""",
)
def circuit_breaker(t):
    """Levels of the breaker on samples made of the events."""
    s = t("events").select("event_id", "user_id", "ts", F.least(F.lit(100.0), "value").alias("mem"), _k().cast("double").alias("cpu"), (F.col("event_id") % 6).alias("browsers"), (_k() + 20).alias("queue_depth"))
    return O.circuit_breaker(s, "user_id", "ts").select("event_id", "level")


@query("search_batches", "SELECT user_id, batch_no, count(*) AS searches, round(sum(value), 2) AS yield FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) / 50) AS INTEGER) AS batch_no FROM events) GROUP BY ALL")
def search_batches(t):
    """Batches of 50 searches of each keyword, here of each user: windows by a key that grows with the data."""
    b = jobs.numbered_batches(t("events"), ["ts", "event_id"], "user_id")
    return b.groupBy("user_id", "batch_no").agg(F.count(F.lit(1)).alias("searches"), F.round(F.sum("value"), 2).alias("yield"))


_MESSAGES = "['Qualified Size: 1-10', 'Exceeds 200 Size:', 'Size: UNKNOWN', 'LISTING page', 'plain']"


@query(
    "batch_evaluation",
    f"""WITH a AS (SELECT user_id % 20 AS batch_id, 'u' || (event_id % 97) AS url, CASE WHEN event_type IN ('click', 'view') THEN 'CRAWL' ELSE 'FILTER' END AS stage, CASE event_type WHEN 'click' THEN 'QUEUED' WHEN 'view' THEN 'QUEUED' WHEN 'error' THEN 'DUPLICATE' ELSE 'FILTERED' END AS status,
  ({_MESSAGES})[CAST(event_id % 5 + 1 AS INTEGER)] AS m FROM events),
b AS (SELECT batch_id, count(*) FILTER (WHERE stage = 'CRAWL' AND status = 'QUEUED') AS relevant, count(*) FILTER (WHERE stage = 'FILTER') AS filtered, count(*) FILTER (WHERE status = 'DUPLICATE') AS duplicates,
  count(*) FILTER (WHERE m LIKE '%1-10%') AS small, count(*) FILTER (WHERE m LIKE 'Exceeds%') AS large, count(*) FILTER (WHERE m LIKE 'Size: UNK%') AS unknown, count(*) FILTER (WHERE m LIKE 'LISTING%') AS directories,
  count(DISTINCT CASE WHEN stage = 'CRAWL' THEN url END) AS websites FROM a GROUP BY batch_id),
c AS (SELECT *, greatest(1, relevant + filtered) AS total FROM b),
d AS (SELECT * EXCLUDE (total), round(relevant / total * 100, 1) AS pct_relevant, round(small / total * 100, 1) AS pct_small, round(unknown / total * 100, 1) AS pct_unknown, round(large / total * 100, 1) AS pct_large FROM c)
SELECT *, CASE WHEN pct_large >= 20 OR (pct_relevant < 50 AND pct_small < 30) THEN 'POOR' WHEN directories > 15 THEN 'ACCEPTABLE' WHEN pct_relevant >= 65 OR pct_small + pct_unknown >= 70 THEN 'GOOD' ELSE 'ACCEPTABLE' END AS quality FROM d""",
)
def batch_evaluation(t):
    """Batch quality over activity made of the events."""
    e, k = F.col("event_type"), F.col("event_id")
    messages = F.array(*map(F.lit, ["Qualified Size: 1-10", "Exceeds 200 Size:", "Size: UNKNOWN", "LISTING page", "plain"]))
    a = t("events").select(
        (F.col("user_id") % 20).alias("batch_id"), F.concat(F.lit("u"), (k % 97).cast("string")).alias("url"), F.when(e.isin("click", "view"), "CRAWL").otherwise("FILTER").alias("stage"),
        F.when(e.isin("click", "view"), "QUEUED").when(e == "error", "DUPLICATE").otherwise("FILTERED").alias("status"), F.element_at(messages, (k % 5 + 1).cast("int")).alias("message"),
    )
    return S.batch_quality(a)


@query(
    "keyword_yield",
    f"""WITH a AS (SELECT user_id, list({{'t': ts, 'g': least(1.0, {_K} % 20 / 15.0 * CASE WHEN event_type = 'purchase' AND value > 0 THEN 1.2 ELSE 0.8 END), 's': {_K} % 20, 'q': event_type = 'error'}} ORDER BY ts, least(1.0, {_K} % 20 / 15.0 * CASE WHEN event_type = 'purchase' AND value > 0 THEN 1.2 ELSE 0.8 END)) AS h FROM events GROUP BY user_id)
SELECT user_id AS keyword, CAST(len(h) AS INTEGER) AS usage_count, round(list_reduce(list_prepend(0.5::DOUBLE, list_transform(h, lambda x: CAST(x.g AS DOUBLE))), lambda a, x: round(a * 0.7::DOUBLE + x * 0.3::DOUBLE, 4)), 3) AS success_rate,
  len(list_filter(list_zip(h, range(len(h))), lambda z: (z[1].s = 0 AND z[2] >= 2) OR (z[1].q AND z[2] >= 1))) > 0 AS is_deprecated FROM a""",
)
def keyword_yield(t):
    """Moving averages of a keyword's yield, a fold in order of time, and deprecation."""
    s = t("events").select(F.col("user_id").alias("keyword"), F.col("ts").alias("executed_at"), (_k() % 20).alias("sources_found"), F.when(F.col("event_type") == "purchase", "GOOD").when(F.col("event_type") == "error", "POOR").otherwise("ACCEPTABLE").alias("quality"), F.when(F.col("value") > 0, 1).otherwise(0).alias("people"))
    return S.keyword_performance(s).withColumn("success_rate", F.round("success_rate", 3))


@query("round_robin", "SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 7 AS turn FROM events")
def round_robin(t):
    return O.round_robin(t("events"), "user_id", ["ts", "event_id"], 7).select("event_id", F.col("turn").cast("long").alias("turn"))


@query("early_stop", f"SELECT event_id, user_id FROM (SELECT *, coalesce(sum({_K}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM events) WHERE s < 250")
def early_stop(t):
    """Each user's events until a running sum is reached."""
    return O.until_sum(t("events").withColumn("k", _k()), "user_id", ["ts", "event_id"], "k", 250).select("event_id", "user_id")


@query("slot_leases", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 90000000 PRECEDING AND 1 PRECEDING) < 2 AS granted FROM events")
def slot_leases(t):
    """Leases of 90 seconds, two at a time."""
    return O.leases(t("events"), "user_id", "ts", 2).select("event_id", "granted")


@query("task_schedule", f"SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY {_K} % 10 DESC, ts, event_id) AS place FROM events")
def task_schedule(t):
    return O.schedule(t("events").withColumn("priority", _k() % 10), "user_id", "priority", "ts", "event_id").select("event_id", F.col("place").cast("long").alias("place"))


@query("dead_letters", f"SELECT event_id, {_K} AS retries FROM events WHERE {_K} >= 95")
def dead_letters(t):
    return O.dead_letters(t("events").withColumn("retries", _k()), "retries", 95).select("event_id", "retries")


@query("elapsed", "SELECT user_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0, 1) AS ms FROM events GROUP BY user_id")
def elapsed(t):
    g = t("events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return g.select("user_id", X.elapsed_ms(F.col("a"), F.col("b")).alias("ms"))


@query("event_payload", f"SELECT event_id, {_K} AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def event_payload(t):
    """JSON path projection and ISO text."""
    return t("events").select("event_id", _k().alias("k"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))
