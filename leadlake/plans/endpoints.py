"""The detail and result reads over whole tables: every row's payload at once, where a service would read one."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leadlake.functions import html as H
from leadlake.functions import text as X
from leadlake.functions import url as U
from leadlake.operators import filters as R
from leadlake.operators import relational as J
from leadlake.operators import resolution as V
from leadlake.operators import scores as S
from leadlake.plans.pages import _HOST, _LINKS, _PAGES, _PARTS, _category, _listed
from leadlake.plans.registry import query
from leadlake.sources import folders, readers

_FILES = [*U.DOCUMENT_ENDINGS, *U.MEDIA_ENDINGS, ".xml", ".json", ".rss"]
_HEAD = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(substring(html, 1, 15000), '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"""
#: First labels that are no name of a profile.
PROFILE_STOP = ("app", "get", "use", "the")


@query("document_detail", rf"""
WITH {_PAGES}, c AS (SELECT domain, min(page_id) AS company_id FROM q WHERE domain LIKE '%.org' GROUP BY domain),
h AS (SELECT page_id, title, replace({_HOST}, 'www.', '') AS shown, {_HEAD} AS body, domain FROM q)
SELECT page_id, shown AS domain, title, CAST(greatest(48, CASE WHEN body = '' THEN 0 ELSE len(string_split(body, ' ')) END) AS INTEGER) AS word_count, md5(substring(body, 1, 3500)) AS preview_md5, 'CRAWLED_PENDING_AGENT_2' AS lifecycle_state, company_id
FROM h LEFT JOIN c USING (domain)""")
def document_detail(t):
    """A crawled document with its preview, its words and the company whose domain is its host's."""
    u, h = F.col("url"), F.col("html")
    p = t("pages").withColumn("root", U.registrable_domain(U.host(u))).withColumn("body", H.head_text(h))
    company = p.where("root like '%.org'").groupBy("root").agg(F.min("page_id").alias("company_id"))
    out = p.select("page_id", "root", F.replace(U.host(u), F.lit("www."), F.lit("")).alias("domain"), H.title(h).alias("title"), F.greatest(F.lit(48), X.words_split(F.col("body"))).alias("word_count"), F.md5(F.substring("body", 1, 3500).cast("binary")).alias("preview_md5"), F.lit("CRAWLED_PENDING_AGENT_2").alias("lifecycle_state"))
    return out.join(company, "root", "left").drop("root")


@query("document_metadata", rf"""
WITH {_PAGES}, l AS (SELECT page_id, lower(regexp_extract(regexp_replace(href, '[?#].*$', ''), '(\.[A-Za-z0-9]{{1,8}})$', 1)) AS e FROM (SELECT page_id, unnest({_LINKS}) AS href FROM pages)),
r AS (SELECT page_id, count(*) AS n FROM l WHERE e IN ({_listed(_FILES)}) GROUP BY page_id)
SELECT q.page_id AS page_id, title, words AS word_count, CAST(len({_LINKS}) AS INTEGER) AS links_count, CAST(len(regexp_extract_all(html, '(?is)<img\b[^>]*>')) AS INTEGER) AS images_count, coalesce(n, 0) AS resources_count FROM q LEFT JOIN r ON r.page_id = q.page_id""")
def document_metadata(t):
    """A document's counts, with the resources that it links to, counted by document."""
    p = R.page_columns(t("pages"))
    links = t("pages").select("page_id", F.explode(H.links(F.col("html"))).alias("l")).select("page_id", U.ending(F.col("l.href")).alias("e"))
    found = links.where(F.col("e").isin(_FILES)).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    out = p.select("page_id", "title", F.col("words").alias("word_count"), F.size(H.links(F.col("html"))).alias("links_count"), F.size(H.media(F.col("html"))).alias("images_count"))
    return out.join(found, "page_id", "left").withColumn("resources_count", F.coalesce("n", F.lit(0).cast("long"))).drop("n")


@query("crawl_pages", "SELECT d.doc_id AS document_id, CASE WHEN l.doc_id IS NULL THEN 'Unknown' ELSE source END AS domain, CAST(coalesce(quality, 0) AS DOUBLE) AS confidence FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def crawl_pages(t):
    """Documents of a crawl with the sector and confidence of their company, defaults for those without one."""
    j = t("documents").select("doc_id", "source").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return j.select(F.col("doc_id").alias("document_id"), F.when(F.col("quality").isNull(), "Unknown").otherwise(F.col("source")).alias("domain"), F.coalesce(F.col("quality").cast("double"), F.lit(0.0)).alias("confidence"))


@query("crawl_results", "SELECT d.doc_id AS document_id, source AS domain, CAST(CASE WHEN quality = 0 THEN 0.9 ELSE quality END AS DOUBLE) AS confidence FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def crawl_results(t):
    """Documents of a crawl that have a company; a confidence of nothing counts as 0.9."""
    j = t("documents").select("doc_id", "source").join(t("labels").select("doc_id", "quality"), "doc_id")
    return j.select(F.col("doc_id").alias("document_id"), F.col("source").alias("domain"), F.when(F.col("quality") == 0, 0.9).otherwise(F.col("quality").cast("double")).alias("confidence"))


_RUNS = "SELECT user_id % 50 AS batch, min(ts) AS started, count(*) AS searches, CAST(coalesce(sum(CAST(json_extract(props, '$.k') AS BIGINT)), 0) AS BIGINT) AS sources FROM events GROUP BY 1"


@query("agent_metrics", f"""
WITH b AS ({_RUNS}), l AS (SELECT batch, searches FROM b ORDER BY started DESC, batch DESC LIMIT 1)
SELECT (SELECT CAST(sum(searches) AS BIGINT) FROM b) AS total_searches, (SELECT CAST(sum(sources) AS BIGINT) FROM b) AS sources_discovered, (SELECT count(*) FROM customer) AS entities_discovered, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS entities_verified, batch AS active_batch, searches AS searches_executed FROM l""")
def agent_metrics(t):
    """Searches, sources, entities, and the latest batch, in one row: each side is one row before the sides meet."""
    b = t("events").groupBy((F.col("user_id") % 50).alias("batch")).agg(F.min("ts").alias("started"), F.count(F.lit(1)).alias("searches"), F.coalesce(F.sum(F.get_json_object("props", "$.k").cast("long")), F.lit(0)).alias("sources"))
    n, one = F.count(F.lit(1)), F.lit(1).alias("_one")
    latest = F.max_by(F.struct("batch", "searches"), F.struct("started", "batch"))
    out = b.agg(F.sum("searches").alias("total_searches"), F.sum("sources").alias("sources_discovered"), latest.alias("l")).select("*", one)
    for side in (t("customer").agg(n.alias("entities_discovered")), t("orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("entities_verified"))):
        out = out.join(side.select("*", one), "_one")
    return out.select("total_searches", "sources_discovered", "entities_discovered", "entities_verified", F.col("l.batch").alias("active_batch"), F.col("l.searches").alias("searches_executed"))


@query("recent_entities", "SELECT o_orderkey AS id, coalesce(nullif(o_orderpriority, '5-LOW'), 'Organization Lead') AS canonical_name, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10")
def recent_entities(t):
    """The ten newest entities (ten is the feature)."""
    o = J.page(t("orders").select("o_orderkey", "o_orderpriority", "o_orderdate"), [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 0, 10)
    name = F.coalesce(F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")), F.lit("Organization Lead"))
    return o.select(F.col("o_orderkey").alias("id"), name.alias("canonical_name"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))


_CONTRACT = """
w AS (SELECT c_custkey AS k, CAST(greatest(0, round(c_acctbal)) AS INTEGER) AS words FROM customer),
f AS (SELECT l_orderkey AS id, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS place, max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS size, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS mail, max(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) AS people, count(*) AS n FROM lineitem GROUP BY 1),
g AS (SELECT o_orderkey AS session_id, o_custkey, o_orderstatus, o_orderpriority, 5 + CASE WHEN words * 6 >= 100 THEN 1 ELSE 0 END + CASE WHEN words >= 20 THEN 1 ELSE 0 END - CASE WHEN words IS NULL THEN 1 ELSE 0 END AS core,
  coalesce(10 * place + 15 * mail + 10 * size + 30 * people, 0) AS earned, coalesce(n, 0) AS evidence FROM orders LEFT JOIN w ON k = o_custkey LEFT JOIN f ON id = o_orderkey),
k AS (SELECT *, CASE WHEN core = 7 THEN 'VERIFIED' WHEN core >= 3 THEN 'PARTIALLY_VERIFIED' ELSE 'NEEDS_REVIEW' END AS state, round(least(100.0, core / 7.0 * 60.0 + earned / 70.0 * 40.0), 1) AS completeness FROM g)"""


def _sessions(t):
    """Sessions, documents, evidence and people made of orders, customers and lines."""
    c = F.col("o_custkey").cast("string")
    o = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), F.concat(F.lit("Company "), c).alias("company_name"), F.concat(F.lit("c"), c, F.lit(".io")).alias("domain"), F.repeat(F.col("o_orderpriority"), 4).alias("description"), F.lit("Software").alias("industry"), F.col("o_orderstatus").alias("status"))
    d = t("customer").select(F.col("c_custkey").alias("id"), F.greatest(F.lit(0), F.round("c_acctbal")).cast("int").alias("word_count"), F.concat(F.lit("vault/raw/"), F.col("c_custkey").cast("string")).alias("raw_path"))
    flag = F.col("l_returnflag")
    e = t("lineitem").select(F.col("l_orderkey").alias("session_id"), F.when(flag == "A", "location_region").when(flag == "N", "company_size_tier").otherwise("verified_contact_email").alias("field"), F.concat(F.col("l_linenumber").cast("string"), F.lit("@x")).alias("value"), F.lit("VERIFIED").alias("status"), F.col("l_shipdate").alias("updated_at"))
    p = t("lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("session_id"), F.lit("VERIFIED").alias("verification_status"))
    return o, d, e, p


@query("session_contracts", f"WITH {_CONTRACT} SELECT session_id, state, CAST(completeness AS DOUBLE) AS completeness FROM k")
def session_contracts(t):
    """The evidence contract over sessions: which core and recommended fields are met, the state that follows."""
    return V.evaluate(V.assemble(*_sessions(t)), "vault").select(F.col("id").alias("session_id"), F.col("contract.state").alias("state"), F.col("contract.completeness").alias("completeness"))


@query("card_detail", f"WITH {_CONTRACT} SELECT session_id, 'c' || o_custkey || '.io' AS domain, o_orderstatus AS status, CASE WHEN length('c' || o_custkey) >= 2 THEN 'https://www.linkedin.com/company/c' || o_custkey END AS linkedin_url, CAST(completeness AS DOUBLE) AS completeness_score, state = 'VERIFIED' AS is_verified, evidence AS evidence_count FROM k")
def card_detail(t):
    """A verification card with its audit, how much evidence it has, and a profile address inferred where none is known."""
    o, d, e, p = _sessions(t)
    v = V.evaluate(V.assemble(o, d, e, p), "vault")
    n = e.groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    known = F.try_element_at("evidence", F.lit("company_linkedin_url"))["value"]
    out = v.select("id", "domain", "status", F.coalesce(X.truthy(known), U.company_profile_guess(F.col("domain"), PROFILE_STOP)).alias("linkedin_url"), F.col("contract.completeness").alias("completeness_score"), (F.col("contract.state") == "VERIFIED").alias("is_verified"))
    return out.join(n, "id", "left").select(F.col("id").alias("session_id"), "domain", "status", "linkedin_url", "completeness_score", "is_verified", F.coalesce("n", F.lit(0).cast("long")).alias("evidence_count"))


@query("card_evidence", "SELECT l_orderkey AS session_id, count(*) AS total_evidence_fields, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS fields, count(*) FILTER (WHERE l_linestatus = 'F') AS verified FROM lineitem GROUP BY 1")
def card_evidence(t):
    """Field by field evidence of each session, counted."""
    g = t("lineitem").groupBy(F.col("l_orderkey").alias("session_id"))
    return g.agg(F.count(F.lit(1)).alias("total_evidence_fields"), F.array_join(X.sorted_set(F.collect_set("l_returnflag")), ",").alias("fields"), F.count_if(F.col("l_linestatus") == "F").alias("verified"))


@query("session_timeline", "SELECT user_id AS session_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS position, event_type AS entry FROM events")
def session_timeline(t):
    """The log of each session in order, with positions."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select(F.col("user_id").alias("session_id"), (F.row_number().over(w) - 1).alias("position"), F.col("event_type").alias("entry"))


@query("activity_union", """
WITH a AS (SELECT event_id AS id, 'telemetry' AS origin, CASE event_type WHEN 'view' THEN 'SEARCH' WHEN 'click' THEN 'CRAWL' WHEN 'purchase' THEN 'VERIFIED' ELSE 'SYSTEM' END AS stage, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_id % 2 = 0),
b AS (SELECT event_id AS id, 'log' AS origin, event_type AS stage, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_id % 2 = 1)
SELECT id, origin, stage FROM a WHERE k <= 40 UNION ALL SELECT id, origin, stage FROM b WHERE k <= 30""")
def activity_union(t):
    """The newest forty of one stream and thirty of another, one after the other (the numbers are the feature)."""
    from leadlake.streaming import jobs

    e = t("events").select(F.col("event_id").alias("id"), "ts", "event_type")
    stage = X.label(F.col("event_type"), {"view": "SEARCH", "click": "CRAWL", "purchase": "VERIFIED"}, "SYSTEM")
    a = jobs.newest(e.where("id % 2 = 0"), "ts", "id", 40).select("id", F.lit("telemetry").alias("origin"), stage.alias("stage"))
    return a.unionByName(jobs.newest(e.where("id % 2 = 1"), "ts", "id", 30).select("id", F.lit("log").alias("origin"), F.col("event_type").alias("stage")))


@query("company_result", """
WITH e AS (SELECT o_orderkey AS id, l_orderkey AS a, l_linenumber AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 30 UNION SELECT o_orderkey, l_orderkey, l_linenumber FROM orders JOIN lineitem ON l_suppkey = o_custkey WHERE l_quantity > 30)
SELECT o_orderkey AS session_id, c_name AS company_name, CASE WHEN c_custkey IS NULL THEN 'NEW' ELSE 'KNOWN' END AS company_status, (SELECT count(*) FROM (SELECT DISTINCT a, b FROM e WHERE e.id = o_orderkey)) AS people FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0""")
def company_result(t):
    """A session with its company, and the people of either: two equi-joins, each person once."""
    p = t("lineitem").where("l_quantity > 30").select("l_orderkey", "l_linenumber", "l_suppkey")
    s = t("orders").select("o_orderkey", "o_custkey")
    people = J.either_key(s, p, [("o_orderkey", "l_orderkey"), ("o_custkey", "l_suppkey")], ["l_orderkey", "l_linenumber"]).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("people"))
    c = t("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("company_name"))
    out = s.join(c, "o_custkey", "left").join(people, "o_orderkey", "left")
    return out.select(F.col("o_orderkey").alias("session_id"), "company_name", F.when(F.col("company_name").isNull(), "NEW").otherwise("KNOWN").alias("company_status"), F.coalesce("people", F.lit(0).cast("long")).alias("people"))


@query("investigation_status", """
WITH s AS (SELECT o_orderkey AS session_id, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'VERIFIED' WHEN 'P' THEN 'PHASE1_VERIFYING' ELSE 'NEEDS_REVIEW' END AS status, o_orderdate AS created, o_totalprice AS score FROM orders), d AS (SELECT l_orderkey AS k, min(l_shipdate) AS crawled, max(l_shipdate) AS ended FROM lineitem GROUP BY 1)
SELECT session_id, status, c_name AS company_name, status = 'VERIFIED' AND created > TIMESTAMP '1998-06-08' AS is_fresh, CASE WHEN score >= 80000 THEN 'HIGH (9)' ELSE 'NORMAL (0)' END AS priority,
  CASE WHEN crawled IS NOT NULL THEN greatest(0, round((epoch_us(crawled) - epoch_us(created)) / 1000.0, 1)) END AS crawl_ms, CASE WHEN status = 'VERIFIED' AND ended IS NOT NULL THEN greatest(0, round((epoch_us(ended) - epoch_us(created)) / 1000.0, 1)) END AS total_ms
FROM s LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN d ON k = session_id""")
def investigation_status(t):
    """Where a session stands: fresh or not, its priority, and how long crawl and verification took, as of a given time."""
    s = F.col("o_orderstatus")
    o = t("orders").select(F.col("o_orderkey").alias("session_id"), "o_custkey", F.when(s == "F", "VERIFIED").when(s == "P", "PHASE1_VERIFYING").otherwise("NEEDS_REVIEW").alias("status"), F.col("o_orderdate").alias("created"), (F.col("o_totalprice") / 1000).alias("score"))
    d = t("lineitem").groupBy(F.col("l_orderkey").alias("session_id")).agg(F.min("l_shipdate").alias("crawled"), F.max("l_shipdate").alias("ended"))
    j = o.join(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("company_name")), "o_custkey", "left").join(d, "session_id", "left")
    fresh = X.fresh(F.col("status"), F.col("created"), F.lit(None).cast("timestamp_ntz"), "1998-06-15 00:00:00")
    ms = lambda end: F.when(F.col(end).isNotNull(), X.elapsed_ms(F.col("created"), F.col(end)))
    return j.select("session_id", "status", "company_name", fresh.alias("is_fresh"), F.when(F.col("score") >= 80, "HIGH (9)").otherwise("NORMAL (0)").alias("priority"), ms("crawled").alias("crawl_ms"), F.when(F.col("status") == "VERIFIED", ms("ended")).alias("total_ms"))


@query("verified_entities", """
WITH s AS (SELECT s_suppkey AS id, s_name AS canonical_name, 's' || s_suppkey || '.io' AS domain, n_name, s_acctbal FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 5 <> 0),
q AS (SELECT *, CAST(15 + 15 + CASE WHEN s_suppkey_even THEN 15 ELSE 8 END + 15 + 10 + 10 + CASE WHEN s_acctbal > 0 THEN 10 ELSE 6 END AS INTEGER) AS lead_quality_score FROM (SELECT *, id % 2 = 0 AS s_suppkey_even FROM s))
SELECT id, canonical_name, domain, n_name AS country, lead_quality_score, round(least(10.0, lead_quality_score / 10.0), 1)::DOUBLE AS warmth_score, 'https://www.linkedin.com/company/s' || id AS linkedin_url, 'Growth SMB (51-200)' AS company_tier FROM q""")
def verified_entities(t):
    """Verified companies whose name and address pass the filters, with quality, warmth, tier and an inferred profile."""
    k = F.col("s_suppkey")
    s = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(k.alias("id"), F.col("s_name").alias("canonical_name"), F.concat(F.lit("s"), k.cast("string"), F.lit(".io")).alias("domain"), F.col("n_name").alias("country"), "s_acctbal", F.when(k % 5 == 0, "DISCOVERED").otherwise("VERIFIED").alias("status"))
    s = s.where(F.col("status").isin("VERIFIED", "Verified", "POSTGRES_VERIFIED")).withColumn("url", F.concat(F.lit("https://www."), "domain"))
    s = s.where(R.filter_url(F.col("url"))["keep"] & R.filter_entity(F.col("canonical_name"), F.col("url"), F.lit(0.85))["keep"])
    people = F.when(F.col("s_acctbal") > 0, F.array(F.lit("J D"), F.lit("K L"))).otherwise(F.array(F.lit("J D")))
    text = F.repeat(F.lit("x"), F.when(F.col("id") % 2 == 0, 50).otherwise(20))
    score = S.quality(F.col("canonical_name"), F.col("domain"), F.lit("Software"), text, F.array(F.lit("a"), F.lit("b")), F.col("country"), F.lit("51-200"), people, F.array().cast("array<string>"))
    return s.withColumn("lead_quality_score", score).select("id", "canonical_name", "domain", "country", "lead_quality_score", S.warmth(F.col("lead_quality_score")).alias("warmth_score"), U.company_profile_guess(F.col("domain"), ("www", *PROFILE_STOP)).alias("linkedin_url"), S.company_tier(F.lit("50-200"), F.lit(0)).alias("company_tier"))


@query("entity_detail", """
WITH p AS (SELECT o_custkey AS k, o_orderpriority AS name, max(o_totalprice) AS score FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice >= 75000 GROUP BY 1, 2)
SELECT c_custkey AS id, c_name AS canonical_name, CASE WHEN c_custkey % 3 = 0 THEN 'Unknown' ELSE 'Berlin, Germany' END AS headquarters, coalesce((SELECT string_agg(name, '; ' ORDER BY name) FROM p WHERE p.k = c_custkey AND lower(name) <> '1-urgent'), '') AS added_people FROM customer""")
def entity_detail(t):
    """An entity with its place, unless that is noise, and the surely matched people of its domain whose names it does not list yet."""
    c = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("canonical_name"), F.when(F.col("c_custkey") % 3 == 0, "a1b2c3d4e5f6g7 x").otherwise("Berlin, Germany").alias("hq"))
    sure = t("orders").where(F.col("o_orderstatus").isin("F", "P") & (F.col("o_totalprice") >= 75000)).select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("name")).distinct()
    listed = c.select("id", F.lit("1-Urgent").alias("name"))
    added = J.new_names(listed, sure, ["id"], "name").where("name <> '1-Urgent'").groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("name")), "; ").alias("added_people"))
    return c.join(added, "id", "left").select("id", "canonical_name", F.coalesce(R.headquarters_or_null(F.col("hq")), F.lit("Unknown")).alias("headquarters"), F.coalesce("added_people", F.lit("")).alias("added_people"))


@query("list_schemas", " UNION ALL ".join(f"SELECT '{n}' AS domain, '1.0.0' AS version, CAST((SELECT count(*) FROM (DESCRIBE {n})) AS INTEGER) AS fields" for n in ("customer", "documents", "part")))
def list_schemas(t):
    """The registered schemas, one of each of a few given tables, with their numbers of fields."""
    r = readers.SchemaRegistry()
    for name in ("part", "Documents", "CUSTOMER"):
        r.register(name, {f.name: {"type": "integer" if f.dataType.simpleString() in ("int", "bigint") else "string"} for f in t(name.lower()).schema})
    rows = [(n, r.schemas[n]["version"], len(r.get(n).fields)) for n in r.names()]
    return t("region").sparkSession.createDataFrame(rows, "domain string, version string, fields int")


@query("enforced_props", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, NULL::VARCHAR AS name, CASE event_id % 3 WHEN 0 THEN 'a|b' WHEN 1 THEN 'x' ELSE '' END AS tags, json_extract_string(props, '$.k') AS said, 1 AS filled FROM events""")
def enforced_props(t):
    """Properties of events held to a schema: declared fields only, lists never null; and read from a reply in a code fence."""
    schema = readers.schema_of({"properties": {"k": {"type": "integer"}, "name": {"type": "string"}, "tags": {"type": "array", "items": {"type": "string"}}}})
    more = F.when(F.col("event_id") % 3 == 0, ', "tags": ["a","b"], "junk": 1}').when(F.col("event_id") % 3 == 1, ', "tags": "x"}').otherwise("}")
    e = t("events").select("event_id", readers.enforce(F.concat(F.regexp_replace("props", r"\}\s*$", ""), more), schema).alias("v"), readers.reply(F.concat(F.lit("```json\n"), F.regexp_replace("props", r"\}\s*$", ', "none": ""}'), F.lit("\n```"))).alias("m"))
    return e.select("event_id", F.col("v.k").cast("int").alias("k"), F.col("v.name").alias("name"), F.array_join("v.tags", "|").alias("tags"), F.try_element_at("m", F.lit("k")).alias("said"), F.size("m").alias("filled"))


@query("quarantined_documents", f"SELECT doc_id, source, {_category('text')} AS category, 'QUARANTINE_AND_BLOCK' AS route FROM documents WHERE ({_category('text')}) IS NOT NULL")
def quarantined_documents(t):
    """Documents that the moderation rules send to quarantine, with the reason."""
    m = R.moderate(F.col("text"), F.lit(0.1))
    d = t("documents").select("doc_id", "source", m["category"].alias("category"), R.moderation_route(m).alias("route"))
    return d.where("route <> 'PASS'")


@query("link_scores", rf"SELECT page_id, CAST(sum(CASE WHEN regexp_matches(lower(l), 'about|team|leadership|management|who-we-are|contact|company|our-story|founders|board') THEN 1 ELSE 0 END) AS BIGINT) AS hints, count(*) AS links, count(DISTINCT regexp_extract(l, '{_PARTS}', 3)) AS paths FROM (SELECT page_id, unnest({_LINKS}) AS l FROM pages) GROUP BY page_id")
def link_scores(t):
    """A page's links: how many look worth reading first, how many paths."""
    e = t("pages").select("page_id", F.explode(H.links(F.col("html"))).alias("l")).select("page_id", F.col("l.href").alias("h"))
    hint = F.lower("h").rlike("about|team|leadership|management|who-we-are|contact|company|our-story|founders|board")
    return e.groupBy("page_id").agg(F.count_if(hint).alias("hints"), F.count(F.lit(1)).alias("links"), F.countDistinct(U.path(F.col("h"))).alias("paths"))


_TABLES = ["customer", "nation", "orders", "part", "region", "supplier"]


@query("table_files", " UNION ALL ".join(f"SELECT '{n}' AS \"table\", '{n}.parquet' AS file, count(*) AS row_count, CAST((SELECT count(*) FROM (DESCRIBE {n})) AS INTEGER) AS columns FROM {n}" for n in _TABLES))
def table_files(t):
    """The files of the given tables, with their rows and columns."""
    spark = t("region").sparkSession
    return folders.probe_tables(spark, {n: f"{t('region').inputFiles()[0].rpartition('/region.parquet')[0]}/{n}.parquet" for n in _TABLES})
