"""The verification session's states as a pure transition, and enums used by dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each state's successor on success.
NEXT = {
    "AGENT2_QUEUED": "PHASE1_RANKED", "PHASE1_RANKED": "PHASE1_VERIFYING", "PHASE1_VERIFYING": "PHASE1_VERIFIED", "PHASE1_BLOCKED": "PHASE1_VERIFYING",
    "PHASE1_VERIFIED": "PHASE2_SYNTHESIS", "PHASE2_SYNTHESIS": "PEOPLE_DISCOVERY", "PEOPLE_DISCOVERY": "PERSON_MATCHING", "PERSON_MATCHING": "FINAL_VERIFICATION",
    "VERIFIED": "POSTGRES_SYNC_PENDING", "POSTGRES_SYNC_PENDING": "POSTGRES_VERIFIED",
}
FINAL = ["POSTGRES_VERIFIED", "PARTIALLY_VERIFIED", "NEEDS_REVIEW"]


def step(status: Column, blocked: Column, verdict: Column) -> Column:
    """The state after one step; the verdict of the contract decides at FINAL_VERIFICATION."""
    table = F.create_map(*[F.lit(x) for kv in NEXT.items() for x in kv])
    held = (status == "PHASE1_VERIFYING") & F.coalesce(blocked, F.lit(False))
    return F.when(held, "PHASE1_BLOCKED").when(status == "FINAL_VERIFICATION", F.coalesce(verdict, F.lit("NEEDS_REVIEW"))).when(status.isin(FINAL), status).otherwise(F.coalesce(F.try_element_at(table, status), status))


def run(sessions: DataFrame, most: int = 20) -> DataFrame:
    """sessions (id, status, blocked, verdict) carried to their last state in at most that many steps, in one expression."""
    state = F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.col("status"), lambda s, _: F.when((s == "PHASE1_BLOCKED") & F.coalesce(F.col("blocked"), F.lit(False)), s).otherwise(step(s, F.col("blocked"), F.col("verdict"))))
    return sessions.withColumn("final_status", state)


def steps(events: DataFrame, key: str, ts: str, patience: int, as_of, start: str = "AGENT2_QUEUED", most: int = 20) -> DataFrame:
    """The last status of each session (key, status, steps) after its events (key, ts, blocked, verdict), in order; as of a time, after which
    no deadline has passed. A session that is blocked for `patience` seconds goes on without. A session's own events are one array."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    e = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(micros.alias("at"), F.coalesce("blocked", F.lit(False)).alias("blocked"), F.coalesce("verdict", F.lit("")).alias("verdict")))).alias("e"))
    end = F.struct(F.unix_micros(F.lit(as_of).cast("timestamp")).alias("at"), F.lit(None).cast("boolean").alias("blocked"), F.lit("").alias("verdict"))
    state = lambda status, verdict, deadline, n: F.struct(status.alias("status"), verdict.alias("verdict"), deadline.cast("long").alias("deadline"), n.cast("long").alias("n"))

    def walk(s, blocked):
        def one(a, _):
            to = F.when((a["status"] == "PHASE1_BLOCKED") & blocked, a["status"]).otherwise(step(a["status"], blocked, F.nullif(a["verdict"], F.lit(""))))
            return state(to, a["verdict"], a["deadline"], a["n"] + (to != a["status"]).cast("long"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(most)), s, one)

    def at_event(a, x):
        due = (a["deadline"] >= 0) & (a["deadline"] <= x["at"])
        forced = walk(state(F.lit("PHASE1_VERIFIED"), a["verdict"], F.lit(-1), a["n"] + 1), F.lit(False))
        a = F.when(due, forced).otherwise(a)
        verdict = F.when(x["verdict"] != "", x["verdict"]).otherwise(a["verdict"])
        b = F.when(x["blocked"].isNull(), a).otherwise(walk(state(a["status"], verdict, a["deadline"], a["n"]), F.coalesce(x["blocked"], F.lit(False))))
        return state(b["status"], b["verdict"], F.when(b["status"] != "PHASE1_BLOCKED", -1).when(b["deadline"] < 0, x["at"] + patience * 1_000_000).otherwise(b["deadline"]), b["n"])

    none = state(F.lit(start), F.lit(""), F.lit(-1), F.lit(0))
    done = F.aggregate(F.concat("e", F.array(end)), none, at_event)
    return e.select(key, done.alias("s")).select(key, F.col("s.status").alias("status"), F.col("s.n").alias("steps"))
