"""The remaining read endpoints: health, moderation queues, resolution, tracking, contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlake.functions import url as U
from leadlake.operators import filters as R
from leadlake.operators import relational as J
from leadlake.operators import resolution as V
from leadlake.operators import windows as O
from leadlake.plans.pages import _HOST, _ROOT, _category, _rx
from leadlake.plans.registry import query


@query("health_rollup", """SELECT user_id, CASE WHEN e > 0.3 OR NOT db THEN 'unhealthy' WHEN n < 60 THEN 'degraded' ELSE 'healthy' END AS status
FROM (SELECT user_id, count(*) AS n, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS e, max(value) < 400 AS db FROM events GROUP BY user_id)""")
def health_rollup(t):
    """Health of each stand-in service from its share of errors, its largest value and its traffic."""
    g = t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("e"), (F.max("value") < 400).alias("db"))
    level = F.when(F.col("e") > 0.3, "EMERGENCY").when(F.col("n") < 60, "PRESSURE").otherwise("NORMAL")
    yes = F.lit(True)
    return g.select("user_id", O.health(level, yes, F.col("db"), yes, yes).alias("status"))


@query("blocked_pages", f"SELECT page_id FROM pages WHERE {_ROOT} IN ('spam-farm.example.org') OR regexp_extract({_ROOT}, '([^.]+[.][^.]+)$', 1) IN ('example.net')")
def blocked_pages(t):
    """Pages whose host or root stands in the blocklist: one equi-join on either key."""
    p = t("pages").select("page_id", "url")
    blocked = p.sparkSession.createDataFrame([("spam-farm.example.org",), ("example.net",)], "domain string")
    return R.blocklist(p, "url", blocked).where("is_blocked").select("page_id")


@query("review_queue", f"SELECT doc_id, source, ({_category('text')}) AS category FROM documents WHERE ({_category('text')}) IS NOT NULL ORDER BY doc_id DESC LIMIT 50")
def review_queue(t):
    """The newest fifty flagged documents (a page is the feature)."""
    d = t("documents").select("doc_id", "source", R.disallowed_category(F.col("text")).alias("category"))
    return d.where("category is not null").orderBy(F.col("doc_id").desc()).limit(50)


_STANDIN = "'maker' || lpad((s_suppkey % 50)::VARCHAR, 4, '0') AS name, CASE WHEN s_suppkey % 50 % 3 = 0 THEN 'm' || (s_suppkey % 50) ELSE 's' || s_suppkey END AS root"


_TWO = f"regexp_extract({_ROOT}, '([^.]+[.][^.]+)$', 1)"


@query("resolve_companies", f"""WITH s AS (SELECT s_suppkey AS id, {_STANDIN} FROM supplier),
r AS (SELECT p_partkey AS request_id, p_partkey % 200 AS k, p_partkey % 200 BETWEEN 150 AND 159 AS part, CASE WHEN p_partkey % 200 BETWEEN 150 AND 159 THEN 'ker00' || (p_partkey % 5) ELSE 'maker' || lpad((p_partkey % 200)::VARCHAR, 4, '0') END AS asked FROM part),
hits AS (SELECT request_id, root, row_number() OVER (PARTITION BY request_id ORDER BY id) AS n, part FROM r JOIN s ON CASE WHEN part THEN contains(name, asked) ELSE name = asked END),
known AS (SELECT request_id, count(DISTINCT root) AS roots FROM hits WHERE n <= CASE WHEN part THEN 10 ELSE 5 END GROUP BY 1),
web AS (SELECT page_id // 2 * 8 % (SELECT count(*) FROM part) + 1 AS request_id, count(DISTINCT {_TWO}) AS roots FROM pages WHERE {_TWO} NOT IN ('', 'example.net') GROUP BY 1)
SELECT r.request_id, CASE WHEN known.roots = 1 THEN 'EXISTING' WHEN known.roots > 1 THEN 'AMBIGUOUS' WHEN web.roots = 1 THEN 'UNIQUE' WHEN web.roots > 1 THEN 'AMBIGUOUS' WHEN r.request_id % 7 = 0 THEN 'RESOLUTION_RETRY_PENDING' ELSE 'NOT_FOUND' END AS status
FROM r LEFT JOIN known USING (request_id) LEFT JOIN web USING (request_id)""")
def resolve_companies(t):
    """Requests resolved against companies by name, by containment for the rest, then by pages as web hits. Companies of one name share a root domain or not."""
    name = lambda c: F.concat(F.lit("maker"), F.lpad(c.cast("string"), 4, "0"))
    k, p = F.col("s_suppkey"), F.col("p_partkey")
    root = F.when(k % 50 % 3 == 0, F.concat(F.lit("www.m"), k % 50)).otherwise(F.concat(F.lit("s"), k))
    s = t("supplier").select(k.alias("id"), name(k % 50).alias("canonical_name"), F.lit(None).cast("string").alias("legal_name"), F.concat(root, F.lit(".io")).alias("primary_domain"))
    asked = F.when((p % 200).between(150, 159), F.concat(F.lit("KER00"), p % 5)).otherwise(F.upper(name(p % 200)))
    r = t("part").select(p.alias("request_id"), F.concat(asked, F.lit(" Ltd.")).alias("company_name"), F.lit(None).cast("string").alias("domain"))
    n = t("part").agg(F.count(F.lit(1)).alias("n"))
    web = t("pages").crossJoin(F.broadcast(n)).select((F.expr("page_id div 2 * 8") % F.col("n") + 1).alias("request_id"), F.col("page_id").alias("rank"), "url", F.lit("").alias("title"))
    blocked = web.sparkSession.createDataFrame([("example.net",)], "domain string")
    return J.resolve(r, s, web, t("part").where(p % 7 == 0).select(p.alias("request_id")), blocked).select("request_id", "status")


@query("investigation_decisions", """SELECT c_custkey AS request_id, CASE WHEN c_custkey % 11 = 0 THEN 'REJECTED_BLOCKED' WHEN o_orderstatus = 'F' AND o_orderdate > TIMESTAMP '1998-06-08' THEN 'CACHE_HIT' WHEN o_orderstatus = 'P' THEN 'ALREADY_RUNNING' ELSE 'AGENT1_QUEUED' END AS decision
FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) ON o_custkey = c_custkey AND k = 1""")
def investigation_decisions(t):
    """Cached, running, blocked or to be queued, as of a given time."""
    host = lambda c: F.concat(F.lit("c"), c.cast("string"), F.lit(".example.io"))
    s = F.col("o_orderstatus")
    sessions = t("orders").select(host(F.col("o_custkey")).alias("domain"), F.when(s == "F", "VERIFIED").when(s == "P", "PHASE1_VERIFYING").otherwise("NEEDS_REVIEW").alias("status"), F.col("o_orderdate").alias("updated_at"), F.lit(None).cast("timestamp_ntz").alias("verified_at"), F.col("o_orderkey").alias("id"))
    requests = t("customer").select(F.col("c_custkey").alias("request_id"), host(F.col("c_custkey")).alias("domain"), (F.col("c_custkey") % 11 == 0).alias("blocked"))
    return J.investigate(requests, sessions, "1998-06-15 00:00:00", ["PHASE1_VERIFYING"]).select("request_id", "decision")


@query("track_domains", """SELECT c_custkey, CASE WHEN o IS NOT NULL THEN o WHEN s_suppkey IS NOT NULL THEN s_suppkey END AS hit_id, CASE WHEN o IS NOT NULL THEN 0 WHEN s_suppkey IS NOT NULL THEN 1 END AS matched_by
FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1) ON o_custkey = c_custkey LEFT JOIN supplier ON s_suppkey = c_custkey""")
def track_domains(t):
    """A cascade of look-ups: session, else company."""
    a = t("orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"))
    b = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("k"))
    out = J.first_match(t("customer").select("c_custkey"), [(a, "c_custkey", "k"), (b, "c_custkey", "k")], "c_custkey")
    return out.select("c_custkey", "hit_id", "matched_by")


def _sector() -> str:
    out = []
    for name, words in V.SECTOR_WORDS.items():
        short, long = [w for w in words if len(w) <= 3], [w for w in words if len(w) > 3]
        rx = "|".join(([rf"(?:^|[^a-z0-9_])(?:{U.quoted(short)})(?:[^a-z0-9_]|$)"] if short else []) + [U.quoted(long)] * bool(long))
        out.append(f"WHEN regexp_matches(low, {_rx(rx)}) THEN {_rx(name)}")
    return "CASE " + " ".join(out) + " ELSE 'Unknown' END"


_PLACE = "CASE " + " ".join(f"WHEN contains(head, '{w}') THEN {_rx(place)}" for w, place in V.CITIES.items()) + " ELSE 'Unknown' END"


@query("inferred_sectors", f"SELECT doc_id, {_sector()} AS sector, {_PLACE} AS place FROM (SELECT doc_id, lower(text) AS low, 'https://x.com ' || lower(split_part(text, chr(10), 1)) AS head FROM documents)")
def inferred_sectors(t):
    """Sector and place of each document by the ladders of words."""
    x = F.col("text")
    none = F.struct(F.lit("").alias("sector"), F.lit(0.0).alias("confidence"))
    return t("documents").select("doc_id", V.inferred_sector(none, x).alias("sector"), V.inferred_location(F.lit("https://x.com"), F.substring_index(x, "\n", 1)).alias("place"))


@query("host_roots", f"SELECT {_HOST} AS host, {_ROOT} AS safety_domain, count(*) AS pages FROM pages GROUP BY ALL")
def host_roots(t):
    return t("pages").groupBy(U.host(F.col("url")).alias("host"), U.safety_domain(F.col("url")).alias("safety_domain")).agg(F.count(F.lit(1)).alias("pages"))
