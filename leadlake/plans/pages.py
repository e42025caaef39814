"""Queries over crawled pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlake.functions import html as H
from leadlake.functions import text as X
from leadlake.functions import url as U
from leadlake.operators import filters as R
from leadlake.operators.relational import page
from leadlake.plans.registry import query

_HOST = r"lower(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?([^/:?#]*)', 1))"
_BARE = rf"regexp_replace({_HOST}, '^www\.', '')"
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _listed(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _rx(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _registrable(host: str) -> str:
    parts = f"string_split({host}, '.')"
    two = f"array_to_string(list_slice({parts}, -2, -1), '.')"
    three = f"array_to_string(list_slice({parts}, -3, -1), '.')"
    return f"CASE WHEN len({parts}) <= 2 THEN {host} WHEN {two} IN ({_listed(U.MULTI_PART_SUFFIXES)}) THEN {three} ELSE {two} END"


def _decoded(c: str) -> str:
    for name, char in H.X.ENTITIES.items():
        c = f"replace({c}, '&{name};', '{char.replace(chr(39), chr(39) * 2)}')"
    return c


def _collapsed(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def _tag(tag: str) -> str:
    inner = rf"regexp_extract(html, '(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>', 1)"
    return f"nullif({_collapsed(_decoded(_collapsed(f'regexp_replace({inner}, $q$<[^>]*>$q$, $q$ $q$, $q$g$q$)')))}, '')".replace("$q$", "'")


def _clean() -> str:
    c = "html"
    for t in H.NOISE:
        c = rf"regexp_replace({c}, '(?is)<{t}\b.*?</{t}\s*>', ' ', 'g')"
    c = rf"regexp_replace({c}, '(?s)<!--.*?-->', ' ', 'g')"
    return _collapsed(_decoded(f"regexp_replace({c}, '<[^>]*>', ' ', 'g')"))


_PAGES = rf"""
p AS (SELECT page_id, url, html, {_HOST} AS host, coalesce({_tag("title")}, {_tag("h1")}) AS title, {_clean()} AS text FROM pages),
q AS (SELECT *, {_registrable("regexp_replace(host, '^www[.]', '')")} AS domain, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS INTEGER) AS words FROM p)
"""

_CONTENT = f"""CASE WHEN words < 15 THEN 'THIN' WHEN title IS NULL OR length(trim(title)) < 3 THEN 'NO_TITLE'
 WHEN regexp_matches(lower(text), {_rx("|".join(R.SPAM_PATTERNS))}) THEN 'SPAM' WHEN regexp_matches(lower(text), {_rx(U.quoted(R.CHALLENGES))}) THEN 'CHALLENGE'
 WHEN regexp_matches(lower(title), {_rx("|".join(R.ERROR_TITLES))}) THEN 'ERROR_TITLE' ELSE 'OK' END"""


@query("crawled_documents", f"WITH {_PAGES} SELECT page_id, host, domain, title, words, {_CONTENT} AS rule_id, {_CONTENT} = 'OK' AS keep FROM q")
def crawled_documents(t):
    """Crawled pages with host, domain, title, words and the content filter's verdict."""
    p = R.page_columns(t("pages"))
    v = R.filter_content(F.col("text"), F.col("title"), F.col("words"))
    return p.withColumn("v", v).select("page_id", "host", "domain", "title", "words", F.col("v.rule_id").alias("rule_id"), F.col("v.keep").alias("keep"))


@query("crawled_documents_page", f"WITH {_PAGES} SELECT page_id, domain, words FROM q ORDER BY words DESC, page_id LIMIT 20 OFFSET 20")
def crawled_documents_page(t):
    """Second page of the list, longest first (a page is the feature here)."""
    return page(R.page_columns(t("pages")).select("page_id", "domain", "words"), [F.col("words").desc(), F.col("page_id")], 20, 20)


@query("page_text", f"WITH {_PAGES} SELECT page_id, md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS n_chars FROM q")
def page_text(t):
    return R.page_columns(t("pages")).select("page_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").alias("n_chars"))


_ROOT = "regexp_extract(replace(regexp_replace(lower(trim(url)), '^https?://', ''), 'www.', ''), '^([^:/]*)', 1)"


@query(
    "url_parts",
    rf"""
WITH a AS (SELECT page_id, url, lower(regexp_extract(url, '{_PARTS}', 1)) AS scheme, {_HOST} AS host, regexp_extract(url, '{_PARTS}', 3) AS path, regexp_extract(url, '{_PARTS}', 4) AS query, {_ROOT} AS d FROM pages),
b AS (SELECT *, string_split(d, '.') AS l,
  array_to_string(list_filter(string_split(query, '&'), lambda kv: regexp_matches(kv, '^[^=]*=.') AND lower(string_split(kv, '=')[1]) NOT IN ({_listed(U.TRACKING_KEYS)})), '&') AS kept,
  CASE WHEN regexp_matches(path, '^.+/$') THEN regexp_replace(path, '/+$', '') ELSE path END AS tidy FROM a)
SELECT page_id, scheme, host, path, query, {_registrable("regexp_replace(host, '^www[.]', '')")} AS registrable,
  CASE WHEN len(l) >= 3 AND l[-2] IN ({_listed(U.ROOT_SECOND_LEVEL)}) THEN array_to_string(list_slice(l, -3, -1), '.') WHEN len(l) >= 2 THEN array_to_string(list_slice(l, -2, -1), '.') ELSE d END AS root,
  scheme || '://' || host || tidy || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS normalized,
  CASE WHEN regexp_matches(lower(url), {_rx(U.quoted(U.PRIORITY_HINTS))}) THEN 0 WHEN regexp_matches(lower(url), {_rx(U.quoted(U.NOISE_HINTS))}) THEN 2 ELSE 1 END AS score
FROM b""",
)
def url_parts(t):
    """The URL algebra on every page address."""
    u = F.col("url")
    return t("pages").select(
        "page_id", U.scheme(u).alias("scheme"), U.host(u).alias("host"), U.path(u).alias("path"), U.query(u).alias("query"), U.registrable_domain(U.host(u)).alias("registrable"),
        U.root_domain(u).alias("root"), U.normalize(u).alias("normalized"), U.link_score(u, F.lit("")).alias("score"),
    )


def _kinds() -> str:
    out = []
    for name, words in U.SUBDOMAIN_KINDS.items():
        hit = f"sub IN ({_listed(words)})" if name == "LANGUAGE_TOOL" else f"regexp_matches(sub, '(?:^|[.-])(?:{'|'.join(words)})(?:[.-]|$)')"
        out.append(f"WHEN {hit} THEN '{name}'")
    return "CASE WHEN sub = '' THEN NULL " + " ".join(out) + " ELSE NULL END"


@query(
    "subdomains",
    rf"""
WITH a AS (SELECT page_id, string_split({_BARE}, '.') AS l FROM pages),
b AS (SELECT *, CASE WHEN len(l) >= 3 AND array_to_string(list_slice(l, -2, -1), '.') IN ({_listed(U.SUBDOMAIN_SUFFIXES)}) THEN 2 ELSE 1 END AS k FROM a),
c AS (SELECT page_id, CASE WHEN len(l) > 2 AND len(l) > k + 1 THEN array_to_string(list_slice(l, -(k + 1), -1), '.') ELSE array_to_string(l, '.') END AS root,
  CASE WHEN len(l) > 2 AND len(l) > k + 1 THEN array_to_string(list_slice(l, 1, len(l) - k - 1), '.') ELSE '' END AS sub FROM b)
SELECT page_id, root, sub AS subdomain, {_kinds()} AS kind, ({_kinds()}) IS NOT NULL AS is_resource FROM c""",
)
def subdomains(t):
    s = U.subdomain(F.col("url"))
    return t("pages").withColumn("s", s).select("page_id", F.col("s.root").alias("root"), F.col("s.subdomain").alias("subdomain"), F.col("s.kind").alias("kind"), F.col("s.is_resource").alias("is_resource"))


_CATEGORY = " ".join(f"WHEN regexp_matches(lower(%s), {_rx(U.quoted(words))}) THEN '{name}'" for name, words in R.DISALLOWED.items())


def _category(c: str) -> str:
    return "CASE " + _CATEGORY.replace("%s", c) + " ELSE NULL END"


@query(
    "url_filter",
    rf"""
WITH a AS (SELECT page_id, url, {_BARE} AS h FROM pages)
SELECT page_id, CASE WHEN NOT starts_with(url, 'http') THEN 'FORMAT' WHEN length(url) > 500 THEN 'LENGTH' WHEN regexp_matches(h, '\.(edu|gov)(\.|$)') THEN 'EDU_GOV'
 WHEN regexp_matches(h, {_rx(rf"(?:{U.quoted(R.MEDIA_TLDS)})(?:\.|$)")}) THEN 'MEDIA_TLD' WHEN regexp_matches(h, {_rx(rf"(?:^|[.\-])(?:{'|'.join(R.MEDIA_WORDS)})(?:[.\-]|$)")}) THEN 'MEDIA_HOST'
 WHEN ({_category("url")}) IS NOT NULL THEN 'CATEGORY' WHEN regexp_matches(h, {_rx("|".join(R.GUIDE_WORDS))}) THEN 'GUIDE'
 WHEN regexp_matches(h, {_rx(rf"^(?:{U.quoted(R.SERVICE_PREFIXES)})")}) THEN 'SERVICE_HOST' WHEN regexp_matches(lower(url), {_rx("|".join(R.PATH_PATTERNS))}) THEN 'PATH'
 WHEN NOT contains(h, '.') THEN 'NO_TLD' ELSE 'OK' END AS rule_id FROM a""",
)
def url_filter(t):
    """The ladder of address rules (no page here has a private host)."""
    return t("pages").select("page_id", R.filter_url(F.col("url"))["rule_id"].alias("rule_id"))


_LINKS = r"""regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a\s*>', 1)"""


@query("page_links", rf"SELECT page_id, CAST(len({_LINKS}) AS INTEGER) AS n_links, CAST(len(regexp_extract_all(html, '(?is)<img\b[^>]*>')) AS INTEGER) AS n_media FROM pages")
def page_links(t):
    return t("pages").select("page_id", F.size(H.links(F.col("html"))).alias("n_links"), F.size(H.media(F.col("html"))).alias("n_media"))


@query("link_targets", rf"SELECT host, href, count(*) AS n FROM (SELECT {_HOST} AS host, unnest({_LINKS}) AS href FROM pages) GROUP BY host, href")
def link_targets(t):
    """Links by host and target: the edge list that a crawl frontier starts from."""
    e = t("pages").select(U.host(F.col("url")).alias("host"), F.explode(H.links(F.col("html"))).alias("l"))
    return e.groupBy("host", F.col("l.href").alias("href")).agg(F.count(F.lit(1)).alias("n"))


def _count_words(words, c="low") -> str:
    return " + ".join(f"CASE WHEN contains({c}, '{w}') THEN 1 ELSE 0 END" for w in words)


@query(
    "listing_pages",
    rf"""
WITH {_PAGES}, a AS (SELECT page_id, url, html, lower(text) AS low, text, regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1) AS hrefs, lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS head,
  regexp_matches(html, '(?is)<title[^>]*>.*?</title>') AS has_title, CASE WHEN regexp_matches(lower(url), {_rx("|".join(R.LISTING_URLS))}) THEN 'listing' WHEN regexp_matches(lower(url), {_rx("|".join(R.ENTITY_URLS))}) THEN 'entity' ELSE 'unknown' END AS by_url FROM q),
b AS (SELECT *, len(list_filter(hrefs, lambda h: starts_with(h, 'http') AND lower(regexp_extract(h, '{_PARTS}', 2)) <> lower(regexp_extract(url, '{_PARTS}', 2)))) AS away, {_count_words(R.LISTING_WORDS)} AS lists, {_count_words(R.ENTITY_WORDS)} AS owns FROM a),
c AS (SELECT *, CASE WHEN away >= 21 THEN 2 WHEN away >= 11 THEN 1 ELSE 0 END + CASE WHEN lists >= 3 THEN 2 WHEN lists >= 1 THEN 1 ELSE 0 END + CASE WHEN owns = 0 THEN 1 ELSE 0 END + CASE WHEN has_title AND regexp_matches(head, {_rx("|".join(R.LISTING_TITLES))}) THEN 1 ELSE 0 END AS hit,
  2 + 2 + CASE WHEN owns >= 3 THEN 2 WHEN owns >= 1 THEN 1 ELSE 0 END + CASE WHEN has_title THEN 1 ELSE 0 END AS total FROM b)
SELECT page_id, CASE WHEN by_url <> 'unknown' THEN by_url WHEN hit / total >= 0.5 THEN 'listing' ELSE 'entity' END AS kind,
  round(CASE by_url WHEN 'listing' THEN 0.95 WHEN 'entity' THEN 0.9 ELSE least(0.95, 0.6 + abs(CAST(hit AS DOUBLE) / total - 0.5) * 0.6) END, 6) AS confidence FROM c""",
)
def listing_pages(t):
    p = R.page_columns(t("pages"))
    k = R.classify_page(F.col("url"), F.col("html"), F.col("text"))
    return p.withColumn("k", k).select("page_id", F.col("k.kind").alias("kind"), F.round("k.confidence", 6).alias("confidence"))


@query(
    "domain_pages",
    f"WITH {_PAGES} SELECT domain, count(*) AS pages, count(DISTINCT host) AS hosts, CAST(sum(words) AS BIGINT) AS words, CAST(count(*) FILTER (WHERE {_CONTENT} = 'OK') AS BIGINT) AS kept, max(page_id) AS newest_page FROM q GROUP BY domain",
)
def domain_pages(t):
    """Pages by registrable domain: one aggregation."""
    p = R.page_columns(t("pages"))
    p = p.withColumn("keep", R.filter_content(F.col("text"), F.col("title"), F.col("words"))["keep"])
    return p.groupBy("domain").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("host").alias("hosts"), F.sum("words").alias("words"), F.count_if("keep").alias("kept"), F.max("page_id").alias("newest_page"))


@query("page_language", r"""SELECT page_id, nullif(substring(split_part(lower(trim(regexp_extract(html, '(?is)<html\b[^>]*?\blang\s*=\s*["'']([^"'']*)["'']', 1))), '-', 1), 1, 10), '') AS language, nullif(string_split(path, '/')[2], '') AS first_folder
FROM (SELECT *, regexp_extract(url, '""" + _PARTS + r"""', 3) AS path FROM pages)""")
def page_language(t):
    return t("pages").select("page_id", H.language(F.col("html")).alias("language"), X.truthy(F.try_element_at(F.split(U.path(F.col("url")), "/"), F.lit(2))).alias("first_folder"))


@query("page_facts")
def page_facts(t):
    """All page facts at once (structured data, contacts, profiles, logo, place); held against inline pages in the tests."""
    h, u = F.col("html"), F.col("url")
    p = t("pages").withColumn("ld", H.json_ld()(h)).withColumn("place", H.location(F.col("ld"), h, u))
    return p.select("page_id", H.title(h).alias("title"), H.description(h).alias("description"), H.canonical(h, u).alias("canonical"), F.array_join(H.contact_mails(h, F.col("ld.mails")), ",").alias("mails"),
                    F.size(H.socials(h)).alias("socials"), F.size(H.listed(h, u)).alias("listed"), H.logo(h, u).alias("logo"), F.col("place.formatted").alias("place"), F.col("ld.type").alias("type"))
