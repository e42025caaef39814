"""Merges, sinks, sources and joins of the record store on stand-ins: suppliers and customers as companies, orders as sessions, lines as hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlake.functions import text as X
from leadlake.functions import url as U
from leadlake.operators import filters as R
from leadlake.operators import merge as M
from leadlake.operators import relational as J
from leadlake.operators import resolution as V
from leadlake.operators import scores as S
from leadlake.operators import windows as O
from leadlake.plans.registry import query
from leadlake.sources import readers, writers


def _site(c):
    return F.concat(F.lit("c"), c.cast("string"), F.lit(".example.io"))


@query("merge_sources", "SELECT s_suppkey % 40 AS site, min(s_suppkey) AS first_key FROM supplier WHERE s_suppkey % 40 < 20 GROUP BY 1 UNION ALL SELECT s_suppkey % 40, -1 FROM supplier WHERE s_suppkey % 40 >= 20 GROUP BY 1")
def merge_sources(t):
    """Sources by address: those that are there stay, the others come in once."""
    s = t("supplier").select((F.col("s_suppkey") % 40).alias("site"), "s_suppkey")
    old = s.where("site < 20").groupBy("site").agg(F.min("s_suppkey").alias("first_key"))
    return M.insert_missing(old, s.select("site", F.lit(-1).cast("long").alias("first_key")), ["site"])


@query("merge_documents", "SELECT 'u' || k AS url, CASE WHEN k % 3 = 0 OR k % 2 = 1 THEN 'new' ELSE 'old' END AS title, CASE WHEN k % 3 = 0 OR k % 2 = 1 THEN n END AS words FROM (SELECT doc_id AS k, n_chars AS n FROM documents)")
def merge_documents(t):
    """Documents by address, every column replaced, by null too where the new value is null."""
    d = t("documents").select(F.col("doc_id").alias("k"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.col("n_chars").alias("words"))
    old = d.where("k % 2 = 0").select("url", F.lit("old").alias("title"), F.lit(None).cast("long").alias("words"))
    new = d.where("k % 3 = 0 or k % 2 = 1").select("url", F.lit("new").alias("title"), "words")
    return M.upsert_documents(old, new)


@query("merge_companies", """
WITH n AS (SELECT o_custkey AS k, max(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END) AS description, min(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END) AS confidence FROM orders WHERE o_custkey % 5 <> 0 GROUP BY 1),
o AS (SELECT c_custkey AS k, c_name, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 4 <> 0)
SELECT 'c' || coalesce(o.k, n.k) || '.example.io' AS primary_domain, CASE WHEN o.k IS NULL THEN 'c' || n.k || '.example.io' ELSE c_name END AS canonical_name, coalesce(nullif(trim(description), ''), c_mktsegment) AS description, coalesce(confidence, c_acctbal) AS confidence, CASE WHEN o.k IS NULL THEN 'DISCOVERED' ELSE 'KEPT' END AS status
FROM o FULL JOIN n ON o.k = n.k""")
def merge_companies(t):
    """Companies by domain: the description changes where the new one says something, the confidence where it is not null; new ones get a name and a status."""
    o = t("customer").where("c_custkey % 4 <> 0").select(_site(F.col("c_custkey")).alias("primary_domain"), F.col("c_name").alias("canonical_name"), F.col("c_mktsegment").alias("description"), F.col("c_acctbal").alias("confidence"), F.lit("KEPT").alias("status"))
    n = t("orders").where("o_custkey % 5 <> 0").groupBy(_site(F.col("o_custkey")).alias("primary_domain")).agg(
        F.max(F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority"))).alias("description"), F.min(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice"))).alias("confidence"),
    )
    return M.upsert_companies(o, n.withColumn("canonical_name", F.lit(None).cast("string")).withColumn("status", F.lit(None).cast("string")))


@query("merge_leads", "SELECT md5('c' || k || '.example.io') AS id, CASE WHEN k % 2 = 0 THEN 'old' ELSE seg END AS logo_url, CASE WHEN k % 3 = 0 THEN NULL ELSE bal END AS score FROM (SELECT c_custkey AS k, c_mktsegment AS seg, c_acctbal AS bal FROM customer)")
def merge_leads(t):
    """Leads by the key of their domain: an empty logo keeps the old one, a null score replaces the old one."""
    k = F.col("c_custkey")
    old = t("customer").select(X.key_of(_site(k)).alias("id"), F.lit("old").alias("logo_url"), F.lit(0.0).alias("score"))
    new = t("customer").select(F.upper(_site(k)).alias("domain"), F.when(k % 2 == 0, " ").otherwise(F.col("c_mktsegment")).alias("logo_url"), F.when(k % 3 != 0, F.col("c_acctbal")).alias("score"))
    return M.upsert_leads(old, new)


@query("person_keys", "SELECT o_orderkey, md5('c' || o_custkey || '.example.io' || ':' || lower(o_orderpriority)) AS id, md5('c' || o_custkey || '.example.io' || '|' || lower(o_orderpriority)) AS other_id FROM orders")
def person_keys(t):
    a, b = F.concat(F.lit(" "), F.upper(_site(F.col("o_custkey")))), F.concat(F.col("o_orderpriority"), F.lit(" "))
    return t("orders").select("o_orderkey", M.person_id(a, b).alias("id"), M.person_id(a, b, "|").alias("other_id"))


@query("merge_metadata", "SELECT 'company' AS entity_type, c_custkey AS entity_key, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS title, CASE WHEN c_custkey % 3 = 0 THEN 'n' ELSE 'o' END AS a, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS b, 'o' AS c, c_custkey % 7 <> 0 AS is_present FROM customer")
def merge_metadata(t):
    """Metadata by type and key: nulls keep, maps merge key by key, then some rows are marked as gone."""
    k = F.col("c_custkey")
    key = [F.lit("company").alias("entity_type"), k.alias("entity_key")]
    old = t("customer").select(*key, F.lit("old").alias("title"), F.create_map(F.lit("a"), F.lit("o"), F.lit("c"), F.lit("o")).alias("extra"), F.lit(True).alias("is_present"))
    new = t("customer").select(*key, F.when(k % 2 == 0, "new").alias("title"), F.when(k % 3 == 0, F.create_map(F.lit("a"), F.lit("n"), F.lit("b"), F.col("c_mktsegment"))).alias("extra"))
    out = M.soft_delete(M.upsert_metadata(old, new), t("customer").where("c_custkey % 7 = 0").select(*key))
    return out.select("entity_type", "entity_key", "title", *[F.try_element_at("extra", F.lit(x)).alias(x) for x in "abc"], "is_present")


@query("outbox_states", """
WITH n AS (SELECT c_custkey % 30 AS k, max(c_name) AS payload FROM customer GROUP BY 1), o AS (SELECT s_suppkey AS k, s_name FROM supplier)
SELECT coalesce('c' || o.k || '.example.io', 'c' || n.k || '.example.io') AS domain, coalesce(n.payload, o.s_name) AS payload, CASE WHEN n.k IS NULL THEN 'COMPLETED' ELSE 'PENDING_SYNC' END AS sync_status, CASE WHEN n.k IS NULL THEN 3 ELSE 0 END AS retry_count FROM o FULL JOIN n ON o.k = n.k""")
def outbox_states(t):
    """Leads put into the outbox: a domain that is there is armed again, others keep their state."""
    old = t("supplier").select(_site(F.col("s_suppkey")).alias("domain"), F.col("s_name").alias("payload"), F.lit("COMPLETED").alias("sync_status"), F.lit(3).alias("retry_count"))
    leads = t("customer").select(F.concat(F.lit("https://www."), _site(F.col("c_custkey") % 30), F.lit("/x")).alias("domain"), F.col("c_name").alias("payload"))
    return M.outbox_enqueue(old, leads)


@query("outbox_summary", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def outbox_summary(t):
    return M.outbox_summary(t("orders").withColumnRenamed("o_orderstatus", "status"))


@query("outbox_flush", """
WITH d AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'RETRY' ELSE 'COMPLETED' END AS status, CAST(o_orderkey % 7 AS INTEGER) AS tries, o_orderdate AS made FROM orders),
q AS (SELECT id, row_number() OVER (ORDER BY made, id) AS k FROM d WHERE status IN ('PENDING', 'RETRY') AND tries < 5)
SELECT id, CASE WHEN k IS NULL OR k > 20 THEN status WHEN id % 2 = 0 THEN 'COMPLETED' WHEN tries + 1 < 5 THEN 'RETRY' ELSE 'FAILED' END AS status, CAST(CASE WHEN k <= 20 AND id % 2 = 1 THEN tries + 1 ELSE tries END AS INTEGER) AS retry_count FROM d LEFT JOIN q USING (id)""")
def outbox_flush(t):
    """The oldest twenty pending rows take the outcome of their try."""
    s, k = F.col("o_orderstatus"), F.col("o_orderkey")
    box = t("orders").select(k.alias("id"), F.when(s == "O", "PENDING").when(s == "P", "RETRY").otherwise("COMPLETED").alias("status"), (k % 7).cast("int").alias("retry_count"), F.col("o_orderdate").alias("created_at"))
    return M.outbox_step(box, box.select("id", (F.col("id") % 2 == 0).alias("ok"))).select("id", "status", "retry_count")


@query("outage_recovery", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'id' WHEN o_custkey % 2 = 0 THEN 'host' ELSE 'new' END AS matched FROM orders WHERE o_orderkey % 5 = 0")
def outage_recovery(t):
    """Rows held back while the store was away: merged by id, else by host, else new."""
    o = t("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("https://"), _site(F.col("o_custkey")), F.lit("/a")).alias("url"), F.lit("PENDING_SYNC").alias("status"), "o_custkey")
    hosts = t("customer").where("c_custkey % 2 = 0").select((-F.col("c_custkey")).alias("id"), F.concat(F.lit("http://"), _site(F.col("c_custkey"))).alias("url"))
    primary = o.where("id % 3 = 0").select("id", F.lit("https://none.example").alias("url")).unionByName(hosts)
    return M.recover(o.where("id % 5 = 0").drop("o_custkey"), primary)[0].select("id", "matched")


@query("replaced_sessions", "SELECT l_orderkey AS session_id, l_linenumber AS line, 'old' AS version FROM lineitem WHERE l_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, 0, 'new' FROM orders WHERE o_orderkey % 4 = 0")
def replaced_sessions(t):
    """Evidence of the sessions that were run again is replaced as a whole."""
    old = t("lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").cast("int").alias("line"), F.lit("old").alias("version"))
    return M.replace_session(old, t("orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("session_id"), F.lit(0).alias("line"), F.lit("new").alias("version")))


@query("rediscovered_people", """
WITH n AS (SELECT o_custkey % 50 AS c, lower(o_orderpriority) AS name, min('u' || o_orderkey) AS url, min(o_orderpriority) AS shown FROM orders GROUP BY 1, 2),
o AS (SELECT c_custkey % 50 AS c, CASE WHEN c_custkey % 2 = 0 THEN '1-urgent' ELSE lower(c_mktsegment) END AS name, min(CASE WHEN c_custkey % 3 = 0 THEN 'k' END) AS url FROM customer GROUP BY 1, 2)
SELECT o.c AS company_id, o.name AS full_name, coalesce(o.url, n.url) AS source_url, CASE WHEN o.url IS NULL AND n.url IS NOT NULL THEN 'HIGH_CONFIDENCE' ELSE 'REVIEW' END AS verification_status FROM o LEFT JOIN n ON o.c = n.c AND o.name = n.name
UNION ALL SELECT n.c, n.shown, 'new', 'NEW' FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.c = n.c AND o.name = n.name)""")
def rediscovered_people(t):
    """People met again get the source they lacked; others are added, whatever the case of their names."""
    name = F.when(F.col("c_custkey") % 2 == 0, "1-urgent").otherwise(F.lower("c_mktsegment"))
    old = t("customer").groupBy((F.col("c_custkey") % 50).alias("company_id"), name.alias("full_name")).agg(F.min(F.when(F.col("c_custkey") % 3 == 0, "k")).alias("source_url")).withColumn("verification_status", F.lit("REVIEW"))
    new = t("orders").groupBy((F.col("o_custkey") % 50).alias("company_id"), F.col("o_orderpriority").alias("full_name")).agg(F.min(F.concat(F.lit("u"), F.col("o_orderkey").cast("string"))).alias("source_url")).withColumn("verification_status", F.lit("NEW"))
    out = M.rediscover_people(old, new)
    return out.withColumn("source_url", F.when(F.col("verification_status") == "NEW", "new").otherwise(F.col("source_url")))


@query("promoted_companies", """
WITH v AS (SELECT o_custkey AS k, max(CASE o_orderstatus WHEN 'F' THEN 'VERIFIED' WHEN 'O' THEN 'NEEDS_REVIEW' ELSE 'PARTIALLY_VERIFIED' END) AS state, max(o_totalprice) AS c FROM orders GROUP BY 1)
SELECT c_custkey AS id, CASE WHEN state = 'VERIFIED' THEN 'VERIFIED' WHEN state IS NOT NULL AND c_custkey % 2 = 0 THEN 'NEEDS_REVIEW' WHEN state IS NOT NULL THEN state WHEN c_custkey % 2 = 0 THEN 'VERIFIED' ELSE 'DISCOVERED' END AS status, coalesce(c, c_acctbal) AS confidence FROM customer LEFT JOIN v ON k = c_custkey""")
def promoted_companies(t):
    """Companies take the state of their contract; a verified one that fails it goes to review."""
    s = F.col("o_orderstatus")
    v = t("orders").groupBy(F.col("o_custkey").alias("company_id")).agg(F.max(F.when(s == "F", "VERIFIED").when(s == "O", "NEEDS_REVIEW").otherwise("PARTIALLY_VERIFIED")).alias("state"), F.max("o_totalprice").alias("confidence"))
    c = t("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, "VERIFIED").otherwise("DISCOVERED").alias("status"), F.col("c_acctbal").alias("confidence"))
    return M.promote(c, v)


@query("moderation_decisions", "SELECT domain, reason_category FROM (SELECT 'c' || s_suppkey || '.example' || (s_suppkey % 9) || '.io' AS domain, 'seed' AS reason_category FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 6 <> 0 UNION ALL SELECT 'd' || s_suppkey || '.sample' || (s_suppkey % 9) || '.io', 'manual_review' FROM supplier WHERE s_suppkey % 3 = 1)")
def moderation_decisions(t):
    """The blocklist after a review: rejected domains come in, released ones go."""
    k = F.col("s_suppkey")
    host = lambda letter, root: F.concat(F.lit(letter), k.cast("string"), F.lit(f".{root}"), (k % 9).cast("string"), F.lit(".io"))
    s = t("supplier")
    blocked = s.where("s_suppkey % 2 = 0").select(host("c", "example").alias("domain"), F.lit("seed").alias("reason_category"), F.lit("import").alias("source"))
    queue = s.select(k.alias("id"), host("d", "sample").alias("domain"), F.lit("pending").alias("status"))
    after = M.review(queue, s.select(k.alias("id"), (k % 3 != 1).alias("approve")), blocked)[1]
    return M.unblock(after, s.where("s_suppkey % 6 = 0").select(F.concat(F.lit("https://"), host("c", "example"), F.lit("/x")).alias("url"))).select("domain", "reason_category")


@query("review_states", "SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'REJECTED' ELSE 'pending' END AS status FROM supplier")
def review_states(t):
    k = F.col("s_suppkey")
    queue = t("supplier").select(k.alias("id"), _site(k).alias("domain"), F.lit("pending").alias("status"))
    none = t("supplier").limit(0).select(F.lit("").alias("domain"), F.lit("").alias("reason_category"), F.lit("").alias("source"))
    return M.review(queue, queue.where("id % 3 < 2").select("id", (F.col("id") % 3 == 0).alias("approve")), none)[0].select("id", "status")


@query("lead_export", r"""
WITH p AS (SELECT o_custkey AS k, string_agg('P' || o_orderkey || ' (' || o_orderpriority || ')', '; ' ORDER BY o_orderkey) AS people FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1)
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS company_name, 'c' || c_custkey || '.example.io' AS domain, 'https://www.c' || c_custkey || '.example.io/home' AS url, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE 'Global' END AS country, 'Not Specified' AS headquarters, c_mktsegment AS industry, 'Unknown' AS company_tier,
  'a@x.io, b@x.io' AS verified_emails, coalesce(people, '') AS decision_makers, '' AS technology_stack, CAST(0.85 AS DOUBLE) AS confidence_score, '' AS summary, '2024-01-02T03:04:05' AS created_at FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN p ON k = c_custkey""")
def lead_export(t):
    """The export's 14 columns over all companies."""
    person = F.struct(F.concat(F.lit("P"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderpriority").alias("title"))
    p = t("orders").where("o_orderkey % 5 = 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", person.alias("p")))), lambda x: x["p"]).alias("people"))
    c = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(p, "c_custkey", "left")
    k = F.col("c_custkey")
    leads = c.select(
        k.alias("id"), F.col("c_name").alias("canonical_name"), F.concat(F.lit("https://www."), _site(k), F.lit("/home")).alias("url"), F.when(k % 2 == 0, F.col("n_name")).alias("country"), F.lit(None).cast("string").alias("headquarters"),
        F.col("c_mktsegment").alias("industry"), F.lit("Unknown").alias("company_tier"), F.array(F.lit("a@x.io"), F.lit("b@x.io")).alias("verified_emails"), "people", F.array().cast("array<string>").alias("technology_stack"),
        F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("description"), F.lit("2024-01-02 03:04:05").cast("timestamp_ntz").alias("created_at"),
    )
    return writers.export(leads)


@query("dead_letter_page", "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 25 OFFSET 25")
def dead_letter_page(t):
    """The second page of failed tasks, newest first (a page is the feature)."""
    letters = t("events").where("event_type = 'error'").select(F.col("ts").alias("failed_at"), F.col("event_id").alias("id"), "user_id")
    return writers.dead_letter_page(letters, 25, 25).select(F.col("id").alias("event_id"), "user_id")


@query("reset_tables", "SELECT c_custkey, c_name FROM customer WHERE false")
def reset_tables(t):
    return writers.empty_like(t("customer").select("c_custkey", "c_name"))


@query("stored_files", "SELECT * FROM (VALUES ('region.parquet', true, NULL), ('nation.parquet', true, NULL), ('other/region.parquet', false, 'NOT_FOUND')) AS v(path, file_exists, error)")
def stored_files(t):
    """Which files are in the store, from its listing; equal names in other folders are other files."""
    spark = t("region").sparkSession
    folder = t("region").inputFiles()[0].rpartition("/region.parquet")[0]
    want = spark.createDataFrame([("region.parquet",), ("nation.parquet",), ("other/region.parquet",)], "path string")
    return writers.existing(want, "path", spark, folder).select("path", F.col("exists").alias("file_exists"), "error")


@query("search_hits", """
WITH h AS (SELECT l_orderkey AS query, l_linenumber AS rank, CASE WHEN l_partkey % 6 = 0 THEN '' ELSE 'https://p' || l_partkey || '.io' END AS url, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE 'T' || l_partkey END AS t FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, url) AS n FROM h WHERE url <> '')
SELECT query, rank, url, coalesce(t, 'B2B Organization') AS title, CAST(1.0 AS DOUBLE) AS score FROM k WHERE n <= 3""")
def search_hits(t):
    """Hits of each search: those with an address, the first three, with defaults for title and score."""
    raw = t("lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("rank"), F.when(F.col("l_partkey") % 6 == 0, "").otherwise(F.concat(F.lit("https://p"), F.col("l_partkey").cast("string"), F.lit(".io"))).alias("url"), F.when(F.col("l_partkey") % 5 != 0, F.concat(F.lit("T"), F.col("l_partkey").cast("string"))).alias("title"), F.lit(None).cast("double").alias("score"))
    return readers.search_results(raw, 3).select("query", "rank", "url", "title", "score")


@query("search_tiers", """
WITH h AS (SELECT o_custkey AS query, 0 AS tier, o_orderkey AS hit FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, 1, o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT c_custkey, 2, c_custkey FROM customer)
SELECT query, tier, hit FROM (SELECT *, min(tier) OVER (PARTITION BY query) AS best FROM h) WHERE tier = best""")
def search_tiers(t):
    """For each search the hits of the first source that has any."""
    o = lambda s: t("orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("hit"))
    return readers.first_tier(o("P"), o("F"), t("customer").select(F.col("c_custkey").alias("query"), F.col("c_custkey").alias("hit"))).select("query", "tier", "hit")


@query("direct_hits", "SELECT 'see p' || p_partkey || '.io and P' || p_partkey || '.IO or none.zz' AS query, 'https://p' || p_partkey || '.io' AS url, 'P' || p_partkey AS title, 'https://www.linkedin.com/company/see' AS profile FROM part")
def direct_hits(t):
    """Hits made of the domains in a search's own text, and of its brand."""
    p = F.col("p_partkey").cast("string")
    q = t("part").select(F.concat(F.lit("see p"), p, F.lit(".io and P"), p, F.lit(".IO or none.zz")).alias("query"))
    profile = readers.profile_hits(q).select("query", F.col("url").alias("profile"))
    return readers.direct_entities(q).join(profile, "query").select("query", "url", "title", "profile")


@query("crawl_order", """
WITH RECURSIVE r(k, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION ALL SELECT l.dst, r.depth + 1 FROM r JOIN (SELECT p_partkey AS src, p_partkey * 2 AS dst FROM part UNION ALL SELECT p_partkey, p_partkey * 2 + 1 FROM part) l ON l.src = r.k WHERE r.depth < 6)
SELECT 'https://s.io/p' || k AS url, depth FROM r""")
def crawl_order(t):
    """Breadth-first over the links of one site, six steps deep; links to other sites are not followed."""
    at = lambda k: F.concat(F.lit("https://s.io/p"), k.cast("string"))
    k = F.col("p_partkey")
    links = t("part").select(at(k).alias("src"), F.explode(F.array(at(k * 2), at(k * 2 + 1), F.concat(F.lit("https://other.io/"), k.cast("string")))).alias("dst"), F.lit(1).alias("score"))
    seeds = links.sparkSession.createDataFrame([("https://s.io/p1",)], "url string")
    return J.crawl_frontier(seeds, links, 6)


@query("people_by_company", r"""
WITH p AS (SELECT 'Firm ' || (o_custkey % 60) || ' Ltd.' AS company, o_orderkey AS person FROM orders WHERE o_orderkey % 8 = 0), f AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'FIRM ' || (s_suppkey % 60) ELSE 'other' END AS name, 'firm' AS label, s_suppkey % 2 = 0 AS named FROM supplier),
m AS (SELECT f.id, p.person, p.company FROM f JOIN p ON lower(regexp_replace(p.company, ' Ltd\.', '')) = lower(f.name)),
r AS (SELECT f.id, p.person, p.company FROM f, p WHERE f.id NOT IN (SELECT id FROM m)), u AS (SELECT * FROM m UNION ALL SELECT * FROM r)
SELECT f.id AS id, array_to_string(list_slice(list_sort(list(DISTINCT u.person)), 1, 5), ',') AS people FROM f LEFT JOIN u ON f.id = u.id GROUP BY f.id""")
def people_by_company(t):
    """People by the company's key; where that finds none, by the domain's first label inside the key of theirs."""
    k = F.col("s_suppkey")
    c = t("supplier").select(k.alias("id"), F.when(k % 2 == 0, F.concat(F.lit("FIRM "), (k % 60).cast("string"))).otherwise("other").alias("name"), F.lit("firm.example.io").alias("domain"))
    p = t("orders").where("o_orderkey % 8 = 0").select(F.col("o_orderkey").alias("person"), F.concat(F.lit("Firm "), (F.col("o_custkey") % 60).cast("string"), F.lit(" Ltd.")).alias("company"))
    out = J.people_of_companies(c, p, "name", "domain", "company", 5)
    return out.select("id", F.array_join(F.transform("people", lambda x: x["person"].cast("string")), ",").alias("people"))


@query("evidence_by_either_key", "SELECT DISTINCT o_orderkey AS session_id, l_orderkey AS line_order, l_linenumber AS line FROM orders JOIN lineitem ON l_orderkey = o_orderkey OR l_suppkey = o_custkey WHERE l_quantity > 40")
def evidence_by_either_key(t):
    """What hangs on a session by either of two keys, once: two equi-joins, never an OR."""
    e = t("lineitem").where("l_quantity > 40").select("l_orderkey", "l_linenumber", "l_suppkey")
    out = J.either_key(t("orders").select("o_orderkey", "o_custkey"), e, [("o_orderkey", "l_orderkey"), ("o_custkey", "l_suppkey")], ["l_orderkey", "l_linenumber"])
    return out.select(F.col("o_orderkey").alias("session_id"), F.col("l_orderkey").alias("line_order"), F.col("l_linenumber").alias("line"))


@query("documents_of_sessions", """
WITH s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS document_id, 'src' || (c_custkey % 25) || '.io' AS host FROM customer),
d AS (SELECT doc_id AS id, source || '.io' AS host FROM documents), n AS (SELECT host, max(id) AS id FROM d GROUP BY host)
SELECT s.id, coalesce(d.id, n.id) AS document_id, CASE WHEN d.id IS NOT NULL THEN 0 WHEN n.id IS NOT NULL THEN 1 END AS matched_by FROM s LEFT JOIN d ON d.id = s.document_id LEFT JOIN n ON n.host = s.host""")
def documents_of_sessions(t):
    """A session's document by its id, else the newest one of its host."""
    k = F.col("c_custkey")
    s = t("customer").select(k.alias("id"), F.when(k % 3 == 0, k).alias("document_id"), F.concat(F.lit("src"), (k % 25).cast("string"), F.lit(".io")).alias("host"))
    d = t("documents").select(F.col("doc_id").alias("doc"), F.concat(F.lit("https://www."), "source", F.lit(".io/"), F.col("doc_id").cast("string")).alias("url"))
    newest = J.latest_by(d.select(U.canonical_domain(F.col("url")).alias("key"), "doc"), ["key"], ["doc"])
    out = J.first_match(s, [(d.select("doc"), "document_id", "doc"), (newest, "host", "key")], "id")
    return out.select("id", F.col("hit_doc").alias("document_id"), "matched_by")


@query("added_people", "SELECT c_custkey % 40 AS company, c_mktsegment AS name FROM customer GROUP BY ALL UNION ALL SELECT DISTINCT o_custkey % 40, o_orderpriority FROM orders")
def added_people(t):
    """Known people and those new ones whose names, whatever their case, are not known."""
    old = t("customer").select((F.col("c_custkey") % 40).alias("company"), F.col("c_mktsegment").alias("name")).distinct()
    new = t("orders").select((F.col("o_custkey") % 40).alias("company"), F.col("o_orderpriority").alias("name")).distinct().unionByName(old.select("company", F.lower(F.concat("name", F.lit(" "))).alias("name")))
    return J.new_names(old, new, ["company"], "name")


@query("evidence_fields", "SELECT l_orderkey AS session_id, l_returnflag AS field, l_linenumber AS value, l_linestatus AS status FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_shipdate DESC, l_linenumber DESC, l_linestatus DESC) AS k FROM lineitem) WHERE k = 1")
def evidence_fields(t):
    """The newest evidence of each field of a session, as a map from field to value."""
    e = t("lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_returnflag").alias("field"), F.col("l_linenumber").alias("value"), F.col("l_linestatus").alias("status"), F.col("l_shipdate").alias("updated_at"))
    return S.evidence_by_field(e).select("session_id", F.explode("evidence").alias("field", "e")).select("session_id", "field", F.col("e.value").alias("value"), F.col("e.status").alias("status"))


@query("first_rows", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k = 1")
def first_rows(t):
    """One row of each key, the one that stands first."""
    return J.keep_first(t("events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("merged_candidates", """
WITH c AS (SELECT o_custkey % 100 AS req, 'd' || (o_orderkey % 9) || '.io' AS root, CASE WHEN o_orderstatus = 'P' THEN 'postgres' ELSE 'web' END AS source, o_orderkey AS position FROM orders)
SELECT req, root, min(position) AS position, CASE WHEN max(CASE WHEN source = 'postgres' THEN position END) IS NOT NULL THEN 'postgres' ELSE 'web' END AS source, coalesce(max(CASE WHEN source = 'postgres' THEN position END), min(position)) AS chosen FROM c GROUP BY req, root""")
def merged_candidates(t):
    """One candidate a root domain: the place of the first, the value of the last one from the store, if there is any."""
    k = F.col("o_orderkey")
    c = t("orders").select((F.col("o_custkey") % 100).alias("req"), F.concat(F.lit("https://www.d"), (k % 9).cast("string"), F.lit(".io")).alias("domain"), F.when(F.col("o_orderstatus") == "P", "postgres").otherwise("web").alias("source"), k.alias("chosen"), k.alias("position"))
    return J.merge_candidates(c, ["req"], "domain", "source", "position").select("req", U.root_domain(F.col("domain")).alias("root"), "position", "source", "chosen")


@query("allowed_pages", "SELECT page_id, NOT (regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) LIKE '/a%' AND page_id % 1 = 0) AS allowed FROM pages")
def allowed_pages(t):
    """Pages that the hosts' rules allow: here every host disallows what begins with /a."""
    rules = t("pages").select(U.host(F.col("url")).alias("host")).distinct().withColumn("disallow", F.lit("/a"))
    return R.robots(t("pages").select("page_id", "url"), "url", rules).select("page_id", "allowed")


@query("page_matches", """
WITH p AS (SELECT source, doc_id % 3 = 0 AS own FROM documents) SELECT source, CASE WHEN round(least(1.0, 0.5 + round(avg(CASE WHEN own THEN 1.0 ELSE 0.0 END) * 0.25, 2) + 0.10), 2) >= 0.65 THEN 'PARTIAL_MATCH' ELSE 'LOW_CONFIDENCE' END AS status, CAST(round(least(1.0, 0.5 + round(avg(CASE WHEN own THEN 1.0 ELSE 0.0 END) * 0.25, 2) + 0.10), 2) AS DOUBLE) AS score FROM p GROUP BY source""")
def page_matches(t):
    """How far the pages crawled for a company are its own."""
    k = F.col("doc_id")
    url = F.when(k % 3 == 0, F.concat(F.lit("https://www."), "source", F.lit(".io/a"))).otherwise(F.lit("https://else.where/b"))
    g = t("documents").groupBy("source").agg(F.collect_list(url).alias("pages"))
    none = F.array().cast("array<string>")
    m = S.company_match(F.concat("source", F.lit(".io")), F.col("source"), F.col("pages"), F.lit(False), none, none)
    return g.select("source", m["status"].alias("status"), m["score"].alias("score"))


@query("tier_filtered_companies", "SELECT c_custkey, c_mktsegment FROM customer WHERE contains(lower(c_mktsegment), 'build') OR contains('build', lower(c_mktsegment))")
def tier_filtered_companies(t):
    """The tier filter, containment either way, and no filter for the word All."""
    c = J.optional(t("customer"), tier=J.tier_filter("Build", "c_mktsegment"), all=J.tier_filter("All", "c_mktsegment"))
    return c.select("c_custkey", "c_mktsegment")


@query("people_searches", "SELECT s_name AS name, 's' || s_suppkey || '.example.io' AS domain, replace(replace(t, '{brand}', s_name), '{domain}', 's' || s_suppkey || '.example.io') AS query, g AS query_group, CAST(p AS INTEGER) AS priority FROM supplier, (VALUES ('{brand} founder', 'founder', 1), ('site {domain} team', 'team', 2)) AS v(t, g, p)")
def people_searches(t):
    """Searches for a company's people by templates with a group and a priority."""
    c = t("supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".example.io")).alias("domain"))
    return readers.people_queries(c, [("{brand} founder", "founder", 1), ("site {domain} team", "team", 2), ("torrent {brand}", "never", 3)])


@query("profile_searches", "SELECT s_name AS name, 's' || s_suppkey || '.io' AS domain, CAST(place AS INTEGER) AS place, replace(replace(t, '{brand}', s_name), '{domain}', 's' || s_suppkey || '.io') AS query FROM supplier, (VALUES (0, '{brand} CEO linkedin profile'), (1, '{brand} founder CEO linkedin'), (2, '{domain} CEO founder linkedin profile'), (3, '{brand} co-founder linkedin'), (4, '{domain} leadership team linkedin'), (5, 'site:linkedin.com/in/ \"{brand}\" CEO'), (6, 'site:linkedin.com/in/ \"{brand}\" founder')) AS v(place, t)")
def profile_searches(t):
    """Searches for profiles, first round; the legal form is no part of the brand."""
    c = t("supplier").select(F.concat("s_name", F.lit(", Inc.")).alias("name"), F.concat(F.lit("www.s"), F.col("s_suppkey").cast("string"), F.lit(".io")).alias("domain"))
    out = V.profile_queries(c, 1)
    return out.select(F.replace("name", F.lit(", Inc."), F.lit("")).alias("name"), F.replace("domain", F.lit("www."), F.lit("")).alias("domain"), "place", F.replace("query", F.lit(", Inc."), F.lit("")).alias("query"))


@query("listing_searches", "SELECT p_brand AS keyword, CAST(place AS INTEGER) AS place, trim(replace(replace(replace(t, '{keyword}', p_brand), '{geo}', 'Europe'), '{years}', '2024 2025')) AS query FROM (SELECT DISTINCT p_brand FROM part), (VALUES (0, 'list of emerging {keyword} startups'), (1, 'top {keyword} startups {geo}'), (2, 'early stage {keyword} companies {geo}'), (3, '{keyword} startups official website'), (4, 'promising {keyword} startups {years}'), (5, '{keyword} innovation startups {geo}')) AS v(place, t)")
def listing_searches(t):
    """Searches for listings of each keyword."""
    k = t("part").select(F.col("p_brand").alias("keyword")).distinct()
    return readers.templated(k, readers.LISTING_TEMPLATES, keyword=F.col("keyword"), geo=F.lit("Europe"), years=F.lit("2024 2025")).select("keyword", "place", "query")


@query("expansion_searches", "SELECT s_name AS name, CAST(place AS INTEGER) AS place, replace(replace(t, '{name}', s_name), '{domain}', 'Energy') AS query FROM supplier, (VALUES (0, '{name} competitors'), (1, 'companies like {name}'), (2, '{name} alternatives'), (3, '{domain} companies similar to {name}'), (4, '{name} industry peers')) AS v(place, t)")
def expansion_searches(t):
    """Searches for what is like an entity that was found."""
    s = t("supplier").select(F.col("s_name").alias("name"))
    return readers.templated(s, readers.EXPANSION_TEMPLATES, name=F.col("name"), domain=F.lit("Energy")).select("name", "place", "query")


@query("discovery_searches", "SELECT count(*) AS queries, count(DISTINCT p_brand) AS subdomains, true AS all_in_list FROM (SELECT DISTINCT p_type, p_brand FROM part)")
def discovery_searches(t):
    """A search for each entry of a taxonomy; place and intent come from a seeded hash, so two runs agree."""
    x = t("part").select(F.lit("Goods").alias("domain"), F.col("p_brand").alias("subdomain"), F.col("p_type").alias("keyword")).distinct()
    q = readers.discovery_queries(x, ["", "Europe", "Japan"], ["pricing", "startups"])
    again = readers.discovery_queries(x.repartition(3), ["", "Europe", "Japan"], ["pricing", "startups"]).withColumnRenamed("query", "again")
    j = q.join(again, ["domain", "subdomain", "keyword"])
    ok = (F.col("query") == F.col("again")) & F.col("query").rlike(r" (pricing|startups)( Europe| Japan)?$") & F.startswith("query", "keyword")
    return j.agg(F.count(F.lit(1)).alias("queries"), F.countDistinct("subdomain").alias("subdomains"), F.bool_and(ok).alias("all_in_list"))


@query("user_locks", """
WITH RECURSIVE r(user_id, ts) AS (SELECT user_id, min(ts) FROM events GROUP BY user_id UNION ALL SELECT r.user_id, min(e.ts) FROM r JOIN events e ON e.user_id = r.user_id AND e.ts >= r.ts + INTERVAL 6 HOUR GROUP BY r.user_id)
SELECT user_id, ts FROM r""")
def user_locks(t):
    """Events that find their user's lock of six hours free and take it."""
    return O.ttl_locks(t("events"), "user_id", "ts", 6 * 3600)
