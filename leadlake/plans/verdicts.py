"""Verdicts on search hits, people and sectors, and places from structured data, each over a whole given table of stand-in records."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlake.functions import facts as E
from leadlake.functions import html as H
from leadlake.operators import filters as R
from leadlake.operators import scores as S
from leadlake.plans.facts import _cases
from leadlake.plans.registry import query

_SAID = ["", "", "a startup", "football fixtures today", "ministry of trade", "a pizza chain", "x"]


@query("qualified_hits", """WITH p AS (SELECT p_partkey AS k, p_partkey % 7 AS c, p_partkey % 300 + 51 AS high, p_partkey % 400 + 1 AS one FROM part)
SELECT k AS p_partkey, c IN (0, 2) OR (c = 1 AND one <= 200) AS qualified, CASE c WHEN 1 THEN CASE WHEN one > 200 THEN 'LARGE_ENTERPRISE' ELSE 'OK' END WHEN 3 THEN 'SPORTS_MEDIA' WHEN 4 THEN 'GOVERNMENT_AGENCY' WHEN 5 THEN 'FRANCHISE_CHAIN' WHEN 6 THEN 'SUBDOMAIN_RESOURCE' ELSE 'OK' END AS rule_id,
  CASE c WHEN 0 THEN '50-' || high WHEN 1 THEN CASE WHEN one > 200 THEN '>200' WHEN one > 1 THEN '1-' || one ELSE '1' END WHEN 2 THEN 'UNKNOWN (Startup Indicator)' WHEN 5 THEN '>200' ELSE 'UNKNOWN' END AS company_size,
  CASE c WHEN 0 THEN CASE WHEN high <= 200 THEN 'HIGH' ELSE 'NORMAL' END WHEN 1 THEN CASE WHEN one > 200 THEN 'DEPRIORITIZED' ELSE 'HIGH' END WHEN 2 THEN 'HIGH' WHEN 5 THEN 'DEPRIORITIZED' ELSE 'REJECTED' END AS priority FROM p""")
def qualified_hits(t):
    """Search hits that could be companies of the wanted size."""
    k = F.col("p_partkey")
    said = F.when(k % 7 == 0, F.concat(F.lit("We have 50-"), k % 300 + 51, F.lit(" employees"))).when(k % 7 == 1, F.concat(F.lit("has "), k % 400 + 1, F.lit(" employees"))).otherwise(_cases(k, _SAID))
    v = R.qualify(F.lit("Acme"), said, F.when(k % 7 == 6, F.concat(F.lit("https://support.acme"), k, F.lit(".io"))).otherwise(F.concat(F.lit("https://acme"), k, F.lit(".io"))))
    return t("part").select("p_partkey", F.inline(F.array(v))).select("p_partkey", "qualified", "rule_id", "company_size", "priority")


@query("person_verdicts", """SELECT c_custkey, ['VERIFIED', 'REJECTED', 'REJECTED', 'REJECTED', 'REVIEW', 'REJECTED'][c_custkey % 6 + 1] AS status, [0.9, 0.0, 0.05, 0.15, 0.6, 0.4][c_custkey % 6 + 1]::DOUBLE AS score, c_custkey % 2 = 0 AS is_leadership,
  CASE WHEN c_custkey % 2 = 0 THEN 'Jane Doe' ELSE 'John Smith' END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'CEO' ELSE 'Founder' END AS role, ['high', 'medium', NULL][c_custkey % 3 + 1] AS relevance FROM customer""")
def person_verdicts(t):
    """People of search hits: who they are, whether the hit is about the company, and how well the evidence holds."""
    k, none = F.col("c_custkey"), F.lit(None).cast("string")
    profile = F.when(k % 6 == 1, none).when(k % 6 == 2, none).otherwise("https://www.linkedin.com/in/jane-doe")
    match = S.person_match(_cases(k, ["Jane Doe", "Jo", *["Jane Doe"] * 4]), F.lit("CEO"), F.lit("Acme"), F.lit("acme.io"), _cases(k, ["Jane Doe acme.io", "acme.io", "a recipe acme.io", "works at Lumo", "CEO at Lumo. Acme partner", "nothing"]), profile, none, none)
    found = S.candidate_match(F.struct(F.lit("VERIFIED").alias("status"), F.lit(0.9).alias("score")), F.lit("https://www.linkedin.com/in/jane-doe"), F.lit("Jane Doe"), F.when(k % 2 == 0, "CEO").otherwise("Gardener"))
    who = E.search_person(F.when(k % 2 == 0, "Jane Doe - CEO - Acme | LinkedIn").otherwise(""), F.when(k % 2 == 0, "").otherwise("Founder of Acme"), F.when(k % 2 == 0, "https://linkedin.com/in/jane-doe").otherwise("https://linkedin.com/in/john-smith-9"))
    about = E.relevance(_cases(k, ["about acme.io", "Jane at Acme!", "Acmes"]), F.lit(""), F.when(k % 3 == 0, "https://z.com").otherwise("https://linkedin.com/in/j"), F.lit("acme.io"), F.lit("Acme"))
    return t("customer").select(
        "c_custkey", match["status"].alias("status"), F.round(match["score"].cast("double"), 4).alias("score"), found["is_leadership"].alias("is_leadership"), who["name"].alias("name"), who["role"].alias("role"), about.alias("relevance")
    )


@query("classified_orders", """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 4 + 1 AS n, o_orderkey % 3 AS c FROM orders)
SELECT k AS o_orderkey, CASE c WHEN 0 THEN CASE WHEN n > 1 THEN 'Software' ELSE 'Retail' END WHEN 1 THEN 'Retail' ELSE 'Professional, Legal & Business Services' END AS sector,
  CASE c WHEN 0 THEN CASE WHEN n > 1 THEN round(n / (n + 1.0), 2) ELSE 0.6 END WHEN 1 THEN 0.67 ELSE 0.5 END::DOUBLE AS confidence FROM o""")
def classified_orders(t):
    """The sector of stand-in texts by words and phrases."""
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.concat(F.repeat(F.lit("api "), (k % 4 + 1).cast("int")), F.lit("store"))).when(k % 3 == 1, "a club card of the store, software").otherwise("robots")
    v = E.classify_sector(F.concat(F.lit("https://u"), k, F.lit(".com/")), F.lit("T"), text, {"Retail": ["store", "club card"], "Software": ["software", "api"]})
    return t("orders").select("o_orderkey", v["sector"].alias("sector"), v["confidence"].cast("double").alias("confidence"))


@query("structured_places", """SELECT page_id, CASE WHEN page_id % 3 < 2 THEN 'Organization' END AS type, CASE page_id % 3 WHEN 0 THEN 'j' || page_id || '@acme.mu' ELSE '' END AS mails, CASE page_id % 3 WHEN 0 THEN (page_id + 5)::VARCHAR END AS employees,
  CASE page_id % 3 WHEN 0 THEN 'Town ' || page_id WHEN 2 THEN 'Port ' || page_id END AS city, CASE page_id % 3 WHEN 1 THEN NULL ELSE 'Mauritius' END AS country, CASE page_id % 3 WHEN 0 THEN 'Town ' || page_id || ', Mauritius' WHEN 1 THEN 'Street ' || page_id || ', Berlin' ELSE 'Port ' || page_id || ', Mauritius' END AS formatted FROM pages""")
def structured_places(t):
    """Facts of each page's structured data, and where the company is by them, else by geo tags; each page gets a head of known contents."""
    n = F.col("page_id").cast("string")
    ld = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<script type="application/ld+json">{"@type": "Organization", "email": "mailto:j'), n, F.lit('@acme.mu", "numberOfEmployees": '), (F.col("page_id") + 5).cast("string"), F.lit(', "address": {"addressLocality": "Town '), n, F.lit('", "addressCountry": {"name": "mu"}}}</script>')))
    ld = ld.when(F.col("page_id") % 3 == 1, F.concat(F.lit('<script type="application/ld+json">{"@graph": [{"@type": "WebSite"}, {"@type": "Organization", "address": "Street '), n, F.lit(', Berlin"}]}</script>')))
    ld = ld.otherwise(F.concat(F.lit('<meta name="geo.placename" content="Port '), n, F.lit('"><meta name="country" content="MU">')))
    p = t("pages").select("page_id", "url", F.concat(ld, F.coalesce("html", F.lit(""))).alias("html")).withColumn("ld", H.json_ld()(F.col("html")))
    place = H.location(F.col("ld"), F.col("html"), F.col("url"))
    return p.select("page_id", F.col("ld.type").alias("type"), F.array_join("ld.mails", "|").alias("mails"), F.col("ld.employees").alias("employees"), place["city"].alias("city"), place["country"].alias("country"), place["formatted"].alias("formatted"))
