"""The relational catalogue on stand-ins: customers and suppliers as companies, orders as sessions, parts as keywords, vectors as embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlake.functions import facts as E
from leadlake.functions import text as X
from leadlake.operators import merge as M
from leadlake.operators import relational as J
from leadlake.operators import scores as S
from leadlake.operators import states
from leadlake.plans.registry import query

TIERS = ["Enterprise", "Mid-Market", "Growth", "Early"]
_TIER = "CASE WHEN c_acctbal >= 8000 THEN 'Enterprise' WHEN c_acctbal >= 4000 THEN 'Mid-Market' WHEN c_acctbal >= 0 THEN 'Growth' ELSE NULL END"


def _tier():
    return F.when(F.col("c_acctbal") >= 8000, "Enterprise").when(F.col("c_acctbal") >= 4000, "Mid-Market").when(F.col("c_acctbal") >= 0, "Growth")


@query("company_search", "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_name ILIKE '%00001%' OR n_name ILIKE '%00001%'")
def company_search(t):
    """Containment in any of several columns, whatever the case."""
    j = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.where(J.contains_any("00001", "c_name", "n_name")).select("c_custkey", "c_name", "n_name")


@query("company_page", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50")
def company_page(t):
    """The third page of 25 of a filtered list."""
    d = J.optional(t("customer"), segment=F.col("c_mktsegment") == "BUILDING", tier=J.tier_filter("All", "c_mktsegment"))
    return J.page(d.select("c_custkey", "c_name", "c_acctbal"), [F.col("c_acctbal").desc(), F.col("c_custkey")], 50, 25)


@query("company_page_count", "SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 25.0)) AS INTEGER) AS pages FROM customer WHERE c_mktsegment = 'BUILDING'")
def company_page_count(t):
    return J.with_page_count(t("customer").where("c_mktsegment = 'BUILDING'"), 25)


@query("latest_session", "SELECT c_custkey, c_name, o_orderkey, o_orderstatus FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) o ON o_custkey = c_custkey AND k = 1")
def latest_session(t):
    """Each company with its latest session."""
    o = J.latest_by(t("orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return t("customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "o_orderkey", "o_orderstatus")


@query("company_people", "SELECT c_custkey, array_to_string(list_slice(list(o_orderkey ORDER BY o_orderkey), 1, 8), ';') AS people FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def company_people(t):
    """At most eight people of each company, in order, joined."""
    g = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.slice(F.array_sort(F.collect_list("o_orderkey")), 1, 8).alias("p"))
    return g.join(t("customer").select("c_custkey"), "c_custkey").select("c_custkey", F.array_join(F.transform("p", lambda x: x.cast("string")), ";").alias("people"))


@query("new_candidates", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def new_candidates(t):
    """Candidates that are not known yet."""
    known = t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").select("c_custkey").join(known, "c_custkey", "left_anti")


@query("blocked_companies", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE'))")
def blocked_companies(t):
    """A semi-join with a small table of blocked keys."""
    n = t("nation").join(t("region").where(F.col("r_name").isin("ASIA", "EUROPE")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"))
    return t("supplier").join(n, "s_nationkey", "left_semi").select("s_suppkey", "s_name")


@query(
    "tier_taxonomy",
    f"""WITH d(tier, place) AS (VALUES ('Enterprise', 0), ('Mid-Market', 1), ('Growth', 2), ('Early', 3)), a AS (SELECT {_TIER} AS tier, count(*) AS n, avg(c_acctbal / 10000) AS v FROM customer GROUP BY 1)
SELECT tier, CAST(place AS INTEGER) AS place, coalesce(n, 0) AS companies, CASE WHEN coalesce(v, 0) = 0 THEN 'N/A' ELSE printf('%.0f', v * 100) || '%' END AS confidence FROM d LEFT JOIN a USING (tier)""",
)
def tier_taxonomy(t):
    """Fixed tiers with counts and mean confidence, empty ones too."""
    return J.tier_rollup(t("customer").withColumn("tier", _tier()).withColumn("c", F.col("c_acctbal") / 10000), "tier", "c", TIERS)


@query("operations_snapshot", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM customer) AS companies, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS verified, (SELECT count(*) FROM orders) AS sessions, (SELECT CAST(coalesce(sum(l_quantity), 0) AS BIGINT) FROM lineitem) AS sources")
def operations_snapshot(t):
    """Five counts in one row; each side is one row before the sides meet."""
    one = lambda df, *aggs: df.agg(*aggs).withColumn("_one", F.lit(1))
    n = F.count(F.lit(1))
    out = one(t("documents"), n.alias("documents"))
    for side in (one(t("customer"), n.alias("companies")), one(t("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("verified"), n.alias("sessions")), one(t("lineitem"), F.coalesce(F.sum("l_quantity"), F.lit(0)).cast("long").alias("sources"))):
        out = out.join(side, "_one")
    return out.drop("_one")


@query("verification_status", "SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS pending, count(*) FILTER (WHERE o_orderstatus = 'P') AS verifying, count(*) FILTER (WHERE o_orderstatus = 'F') AS verified, count(*) AS total FROM orders")
def verification_status(t):
    s = F.col("o_orderstatus")
    return J.buckets(t("orders"), pending=s == "O", verifying=s == "P", verified=s == "F")


@query("verification_cards", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def verification_cards(t):
    """Cards by priority: the first twenty."""
    return J.page(t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 0, 20)


@query("keyword_top20", "SELECT p_brand, count(*) AS usage_count, round(avg(p_retailprice), 2) AS price FROM part GROUP BY p_brand ORDER BY usage_count DESC, p_brand LIMIT 20")
def keyword_top20(t):
    g = t("part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("usage_count"), F.round(F.avg("p_retailprice"), 2).alias("price"))
    return g.orderBy(F.col("usage_count").desc(), "p_brand").limit(20)


@query("entity_choices", "SELECT DISTINCT c_mktsegment FROM (SELECT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL UNION ALL SELECT unnest(['AUTOMOBILE', 'ZZZ'])) ORDER BY 1")
def entity_choices(t):
    return J.choices(t("customer"), "c_mktsegment", ["AUTOMOBILE", "ZZZ"])


@query("company_merge", """
WITH n AS (SELECT o_custkey AS k, max(CASE WHEN o_orderpriority LIKE '1%' THEN '' ELSE o_orderpriority END) AS seg, max(o_totalprice) AS bal FROM orders GROUP BY 1)
SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(c_name, 'Unknown') AS c_name, coalesce(nullif(seg, ''), c_mktsegment) AS c_mktsegment, CASE WHEN k IS NULL THEN c_acctbal ELSE bal END AS c_acctbal FROM customer FULL JOIN n ON c_custkey = k""")
def company_merge(t):
    """An upsert with a rule for each column: one kept, one only where the new value says something, one overwritten."""
    new = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_orderpriority").startswith("1"), "").otherwise(F.col("o_orderpriority"))).alias("c_mktsegment"), F.max("o_totalprice").alias("c_acctbal"))
    old = t("customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return M.merge(old, new, ["c_custkey"], {"c_mktsegment": "truthy_wins", "c_acctbal": "overwrite"}, {"c_name": F.lit("Unknown")})


@query("duplicate_companies", """
WITH c AS (SELECT c_custkey, 'n' || (c_custkey % 700) AS name, 'h' || (c_custkey % 900) AS host FROM customer), m AS (SELECT *, min(c_custkey) OVER (PARTITION BY name) AS a, min(c_custkey) OVER (PARTITION BY host) AS b FROM c)
SELECT c_custkey, CASE WHEN a < c_custkey OR b < c_custkey THEN 'Duplicate' ELSE 'Unique' END AS status FROM m""")
def duplicate_companies(t):
    """Rows that share a name or a host with an earlier one."""
    c = t("customer").select("c_custkey", F.concat(F.lit("n"), (F.col("c_custkey") % 700).cast("string")).alias("name"), F.concat(F.lit("h"), (F.col("c_custkey") % 900).cast("string")).alias("host"))
    return J.duplicates(c, "c_custkey", "name", "host").select("c_custkey", "status")


@query("export_leads", "SELECT c_custkey, c_name AS company, n_name AS country, string_agg(p, ', ' ORDER BY p) AS priorities FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT DISTINCT o_custkey, o_orderpriority AS p FROM orders) ON o_custkey = c_custkey GROUP BY ALL")
def export_leads(t):
    """Flat rows with arrays joined."""
    p = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(X.sorted_set(F.collect_set("o_orderpriority")), ", ").alias("priorities"))
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.join(p, "c_custkey").select("c_custkey", F.col("c_name").alias("company"), F.col("n_name").alias("country"), "priorities")


@query("company_keys", r"SELECT c_custkey, lower(regexp_replace(trim(regexp_replace(c_name || ', Inc.', '(?i)\b(inc\.?|ltd\.?|company)\b', '', 'g'), ' ,.-'), '\s+', ' ', 'g')) AS key, md5(lower(trim(c_name))) AS id FROM customer")
def company_keys(t):
    return t("customer").select("c_custkey", X.company_key(F.concat("c_name", F.lit(", Inc."))).alias("key"), X.key_of(F.col("c_name")).alias("id"))


@query("size_tiers", "SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'Startup / Micro (1-10)' WHEN p_size <= 50 THEN 'Small (11-50)' ELSE 'Growth SMB (51-200)' END AS tier, CASE WHEN p_size <= 10 THEN '1-10' ELSE '11-50' END AS bucket, CASE WHEN (p_size + 2 * p_size) // 2 <= 10 THEN 'Startup / Micro (1-10)' WHEN (p_size + 2 * p_size) // 2 <= 50 THEN 'Small (11-50)' ELSE 'Growth SMB (51-200)' END AS span_tier FROM part")
def size_tiers(t):
    n = F.col("p_size")
    span = F.concat_ws("-", n.cast("string"), (n * 2).cast("string"))
    return t("part").select("p_partkey", E.size_tier(n).alias("tier"), E.size_bucket(n).alias("bucket"), E.standard_tier(span).alias("span_tier"))


@query("rank_cards", "SELECT o_orderkey, least(100.0, greatest(10.0, 40.0 + CASE WHEN w > 1000 THEN 15 WHEN w > 300 THEN 8 ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 15 ELSE 0 END + CASE WHEN o_orderstatus = 'O' THEN 15 ELSE 0 END + CASE WHEN d >= 5 THEN 15 WHEN d >= 1 THEN 8 ELSE 0 END))::DOUBLE AS score FROM (SELECT *, CAST(o_totalprice / 100 AS INTEGER) AS w, o_orderkey % 7 AS d FROM orders)")
def rank_cards(t):
    """Which session to verify first."""
    s = F.col("o_orderstatus")
    some = lambda hit: F.when(hit, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    pages = F.slice(F.array_repeat(F.lit("p"), 6), F.lit(1), (F.col("o_orderkey") % 7).cast("int"))
    p = S.priority(F.round(F.col("o_totalprice") / 100).cast("int"), some(s == "F"), some(s == "O"), pages)
    return t("orders").select("o_orderkey", p["score"].alias("score"))


@query("session_states", """SELECT o_orderkey, CASE WHEN blocked THEN 'PHASE1_BLOCKED' ELSE CASE WHEN v = 'VERIFIED' THEN 'POSTGRES_VERIFIED' ELSE v END END AS final_status
FROM (SELECT o_orderkey, o_orderkey % 5 = 0 AS blocked, CASE o_orderstatus WHEN 'F' THEN 'VERIFIED' WHEN 'P' THEN 'PARTIALLY_VERIFIED' ELSE 'NEEDS_REVIEW' END AS v FROM orders)""")
def session_states(t):
    """Sessions carried through the state machine in one expression."""
    s = F.col("o_orderstatus")
    d = t("orders").select("o_orderkey", F.lit("AGENT2_QUEUED").alias("status"), (F.col("o_orderkey") % 5 == 0).alias("blocked"), F.when(s == "F", "VERIFIED").when(s == "P", "PARTIALLY_VERIFIED").otherwise("NEEDS_REVIEW").alias("verdict"))
    return states.run(d).select("o_orderkey", "final_status")


@query("evidence_pick", "SELECT l_orderkey AS session_id, l_returnflag AS field, l_linenumber AS strategy FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS k FROM lineitem WHERE l_quantity > 10) WHERE k = 1")
def evidence_pick(t):
    """The first strategy of each session and field that found something."""
    c = t("lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_returnflag").alias("field"), F.col("l_linenumber").alias("strategy_order"), F.when(F.col("l_quantity") > 10, F.col("l_linenumber").cast("string")).alias("value"), F.lit("u").alias("source_url"), F.lit("s").alias("snippet"), F.lit("m").alias("method"))
    return J.pick_evidence(c).select("session_id", "field", F.col("value").cast("int").alias("strategy"))


@query("session_evidence", "SELECT l_orderkey AS session_id, count(DISTINCT l_returnflag) AS fields, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS verified, round(sum(l_extendedprice), 2) AS weight FROM lineitem GROUP BY 1")
def session_evidence(t):
    """Evidence by session: the scan reads four columns, the aggregation combines before its shuffle."""
    g = t("lineitem").groupBy(F.col("l_orderkey").alias("session_id"))
    return g.agg(F.countDistinct("l_returnflag").alias("fields"), F.sum(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("verified"), F.round(F.sum("l_extendedprice"), 2).alias("weight"))


@query("session_documents", "SELECT o_orderkey, c_name, count(l_linenumber) AS documents, CAST(round(coalesce(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 6))), 0), 2) AS DOUBLE) AS weight FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, c_name")
def session_documents(t):
    """Sessions with their company and what hangs on them: aggregate first, then join."""
    l = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,6)")).alias("weight"))
    o = t("orders").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").join(l, "o_orderkey", "left")
    return o.select("o_orderkey", "c_name", F.coalesce("documents", F.lit(0)).alias("documents"), F.round(F.coalesce("weight", F.lit(0).cast("decimal(28,6)")), 2).cast("double").alias("weight"))


@query("country_rollup", "SELECT r_name, n_name, count(*) AS companies, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def country_rollup(t):
    j = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("companies"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


_COS = "round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))), 6)"


@query("semantic_topk", f"SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, score FROM (SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q) WHERE rank <= 10")
def semantic_topk(t):
    """Exact cosine top ten of every vector whose id is divisible by 20, over all vectors."""
    v = t("embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("query"))
    return J.top_k(v, q, 10).select("query_id", "vec_id", "rank", "score")


@query("semantic_topk_approximate")
def semantic_topk_approximate(t):
    """The same by an inverted file over all vectors; the tests measure recall at these parameters."""
    v = t("embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return J.top_k_approximate(v, q, 10).select("query_id", "vec_id", "rank", "score")
