"""Field investigations over documents as sessions, with documents and pages as search hits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadlake.functions import facts as E
from leadlake.functions import html as H
from leadlake.functions import url as U
from leadlake.operators import crawl as C
from leadlake.operators import filters as R
from leadlake.operators import investigation as V
from leadlake.plans.pages import _PAGES, _rx
from leadlake.plans.registry import query

_MAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
_YEAR = r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)"
_COUNT = r"([1-9][0-9]{0,3}) (?:[a-z]+)"

FIELDS = [
    V.Field("verified_contact_email", lambda t: F.get(E.prose_mails(t, 1), F.lit(0)), "/contact", ("contact_page", "footer_or_body", "search_email"), lambda t: F.when(F.contains(t, F.lit("@")), F.regexp_extract(t, _MAIL, 0))),
    V.Field("contact_phone", E.phone, "/contact", ("contact_page", "footer_or_body", "search_phone")),
    V.Field("location_region", lambda t: F.regexp_extract(t, _YEAR, 1), "/about", ("contact_or_locations", "about_or_company", "search_location"), lambda t: F.regexp_extract(t, _COUNT, 1)),
]


def _sql_mail(t: str, strict: bool) -> str:
    if not strict:
        return f"nullif(regexp_extract({t}, '{_MAIL}'), '')"
    return rf"list_filter(regexp_extract_all({t}, '{_MAIL}'), lambda e: NOT regexp_matches(lower(e), 'example\.com|domain\.com|wixpress|sentry'))[1]"


def _sql_phone(t: str) -> str:
    found = rf"regexp_extract({t}, '(\+?[0-9][0-9 \t\n\r().\-]{{6,}}[0-9])', 1)"
    return f"CASE WHEN length(regexp_replace({found}, '[^0-9]', '', 'g')) BETWEEN 8 AND 15 THEN trim({found}) END"


def _sql_value(t: str) -> str:
    return f"CASE field WHEN 'verified_contact_email' THEN {_sql_mail(t, True)} WHEN 'contact_phone' THEN {_sql_phone(t)} ELSE nullif(regexp_extract({t}, '{_YEAR}', 1), '') END"


@query("field_investigations", f"""WITH {_PAGES},
fields(field, path) AS (VALUES ('verified_contact_email', '/contact'), ('contact_phone', '/contact'), ('location_region', '/about')),
base AS (SELECT doc_id AS session_id, doc_id % 13 = 0 AS failed, field, path, 'https://d' || doc_id || '.io' AS site, {_sql_value('text')} AS v1,
  CASE field WHEN 'verified_contact_email' THEN {_sql_mail('text', False)} WHEN 'contact_phone' THEN {_sql_phone('text')} ELSE nullif(regexp_extract(text, '{_COUNT}', 1), '') END AS v2 FROM documents, fields),
hits AS (SELECT doc_id + 1 AS session_id, 1 AS rank, 'https://h' || doc_id || '.io/about' AS url, trim(text) AS said FROM documents UNION ALL SELECT doc_id + 2, 2, 'https://h' || doc_id || '.io/news', trim(text) FROM documents
  UNION ALL SELECT page_id * 4 + k, 3, url, '' FROM pages, range(4) r(k)),
placed AS (SELECT *, CASE WHEN regexp_matches(lower(url), {_rx(U.quoted(U.PRIORITY_HINTS))}) THEN 0 WHEN regexp_matches(lower(url), {_rx(U.quoted(U.NOISE_HINTS))}) THEN 2 ELSE 1 END AS score FROM hits),
third AS (SELECT session_id, field, value, url FROM (SELECT *, row_number() OVER (PARTITION BY session_id, field ORDER BY score, rank, url) AS k FROM (SELECT b.session_id, field, {_sql_value('said')} AS value, score, rank, url FROM base b JOIN placed USING (session_id) WHERE v1 IS NULL AND v2 IS NULL AND NOT failed) WHERE value IS NOT NULL) WHERE k = 1),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score, rank, url) AS k FROM placed) WHERE k <= 3),
fourth AS (SELECT session_id, field, value, url FROM (SELECT *, row_number() OVER (PARTITION BY session_id, field ORDER BY score, rank, url, value) AS k FROM (SELECT b.session_id, field, {_sql_value('q.text')} AS value, score, rank, top.url FROM base b JOIN top USING (session_id) JOIN q ON q.url = top.url
  WHERE v1 IS NULL AND v2 IS NULL AND NOT failed AND NOT EXISTS (SELECT 1 FROM third t WHERE t.session_id = b.session_id AND t.field = b.field)) WHERE value IS NOT NULL) WHERE k = 1)
SELECT b.session_id, b.field, CASE WHEN v1 IS NOT NULL THEN 1 WHEN v2 IS NOT NULL THEN 2 WHEN t.url IS NOT NULL THEN 3 WHEN f.url IS NOT NULL THEN 4 END AS strategy, coalesce(v1, v2, t.value, f.value) AS value,
  CASE WHEN v1 IS NOT NULL THEN site WHEN v2 IS NOT NULL THEN site || path ELSE coalesce(t.url, f.url) END AS source_url,
  CASE WHEN coalesce(v1, v2, t.value, f.value) IS NOT NULL THEN 'VERIFIED' WHEN failed OR b.field = 'contact_phone' THEN 'UNVERIFIED' ELSE 'NOT_FOUND_AFTER_SEARCH' END AS status
FROM base b LEFT JOIN third t USING (session_id, field) LEFT JOIN fourth f USING (session_id, field)""")
def field_investigations(t):
    """Each field of each session by the first strategy that finds it: own text, credited page, search snippets, fetched pages."""
    d, p = t("documents"), t("pages")
    sessions = d.select(F.col("doc_id").alias("session_id"), F.concat(F.lit("d"), "doc_id", F.lit(".io")).alias("domain"), "text", (F.col("doc_id") % 13 == 0).alias("search_failed"))
    none = F.lit(None).cast("string").alias("title")
    hit = lambda n, path: d.select((F.col("doc_id") + n).alias("session_id"), F.lit(n).alias("rank"), F.concat(F.lit("https://h"), "doc_id", F.lit(".io" + path)).alias("url"), none, F.col("text").alias("snippet"))
    paged = p.select(F.explode(F.sequence(F.col("page_id") * 4, F.col("page_id") * 4 + 3)).alias("session_id"), F.lit(3).alias("rank"), "url", none, F.lit("").alias("snippet"))
    hits = hit(1, "/about").unionByName(hit(2, "/news")).unionByName(paged)
    return V.investigate(sessions, hits, R.page_columns(p).select("url", "text"), FIELDS).select("session_id", "field", "strategy", "value", "source_url", "status")


def site_links(pages):
    """Links of the pages (src, dst, place, text): their own, and of each site's n-th page by number to its pages 2 n and 2 n + 1."""
    p = pages.select("page_id", "url", U.host(F.col("url")).alias("host"), "html").withColumn("n", F.row_number().over(W.partitionBy("host").orderBy("page_id")))
    own = p.select(F.col("url").alias("src"), F.posexplode(H.links(F.col("html"))).alias("place", "l"))
    own = own.select("src", U.resolve(F.col("l.href"), F.col("src")).alias("dst"), "place", F.col("l.text").alias("text"))
    child = p.select("host", F.col("n").alias("m"), F.col("url").alias("dst"))
    tree = p.select("host", F.col("url").alias("src"), F.explode(F.array(F.col("n") * 2, F.col("n") * 2 + 1)).alias("m")).join(child, ["host", "m"])
    return own.unionByName(tree.select("src", "dst", (F.col("m") + 100000).alias("place"), F.when(F.col("m") % 3 == 0, "contact").alias("text")))


@query("priority_crawl")
def priority_crawl(t):
    """Each host crawled from its first address: eight pages at most, three links deep, the best links first."""
    p = t("pages")
    seeds = p.select(U.host(F.col("url")).alias("site"), "url")
    return C.crawl(seeds, site_links(p), max_pages=8, max_depth=3)
