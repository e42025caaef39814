"""Functions over addresses, markup, names, records and prose, each over a whole given table."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlake.functions import facts as E
from leadlake.functions import html as H
from leadlake.functions import text as X
from leadlake.functions import url as U
from leadlake.operators import filters as R
from leadlake.operators import scores as S
from leadlake.operators.relational import request_error
from leadlake.plans.pages import _BARE, _LINKS, _PARTS, _rx
from leadlake.plans.registry import query
from leadlake.sources import writers

_FILES = [".pdf", "/l.PNG", ".xlsx", "/feed", "", ".txt?v=1"]
_FILE_SQL = "[" + ", ".join(_rx(x) for x in _FILES) + "][page_id % 6 + 1]"


def _cases(c, values):
    """The value at c modulo their number."""
    out = F.lit(values[-1])
    for i, v in list(enumerate(values))[-2::-1]:
        out = F.when(c % len(values) == i, v).otherwise(out)
    return out


@query("url_resources", rf"""WITH a AS (SELECT page_id, regexp_extract(url, '{_PARTS}', 1) || '://' || regexp_extract(url, '{_PARTS}', 2) AS root, {_BARE} AS bare, url FROM pages),
b AS (SELECT *, root || '/files/r' || page_id || {_FILE_SQL} AS u FROM a), p AS (SELECT *, regexp_extract(u, '{_PARTS}', 3) AS path FROM b), e AS (SELECT *, string_split(path, '/')[-1] AS base, lower(regexp_extract(string_split(path, '/')[-1], '(\.[A-Za-z0-9]{{1,8}})$', 1)) AS e FROM p)
SELECT page_id, CASE WHEN e IN ('.pdf', '.xlsx', '.txt') THEN 'document' WHEN e = '.png' THEN 'media' ELSE 'web_resource' END AS type,
  CASE e WHEN '.pdf' THEN 'application/pdf' WHEN '.xlsx' THEN 'application/octet-stream' WHEN '.txt' THEN 'text/plain' WHEN '.png' THEN 'image/png' ELSE CASE WHEN regexp_matches(path, 'sitemap|robots.txt|feed|rss|atom') THEN 'application/xml' ELSE 'text/html' END END AS mime,
  CASE WHEN e <> '' THEN e WHEN regexp_matches(path, 'sitemap|robots.txt|feed|rss|atom') THEN '.xml' ELSE '.html' END AS ending, base AS name, 'https://' || bare || '/favicon.ico' AS favicon, root,
  CASE WHEN trim(regexp_extract(url, '{_PARTS}', 3), '/') = '' THEN 'homepage' ELSE replace(trim(regexp_extract(url, '{_PARTS}', 3), '/'), '/', '_') END AS slug, left(sha256('page:' || url), 32) AS cache_key, 'resource_' || left(md5(root || '/'), 8) AS nameless
FROM e""")
def url_resources(t):
    """What links point to: type, MIME, ending and name of a file of each page's site; icon, root, slug and cache key of the page."""
    p = t("pages")
    url = F.col("url")
    file = F.concat(U.site_root(url), F.lit("/files/r"), F.col("page_id"), _cases(F.col("page_id"), _FILES))
    return p.select(
        "page_id", U.resource(file)["type"].alias("type"), U.resource(file)["mime"].alias("mime"), U.resource(file)["ending"].alias("ending"), U.resource_name(file).alias("name"), U.favicon(url).alias("favicon"),
        U.site_root(url).alias("root"), U.path_slug(url).alias("slug"), U.cache_key(F.lit("page"), url).alias("cache_key"), U.resource_name(F.concat(U.site_root(url), F.lit("/"))).alias("nameless"),
    )


@query("resources_of_documents", r"""WITH r AS (SELECT page_id, regexp_extract(url, '^[^:]+://([^/?#]+)', 1) AS host, unnest(list_distinct(""" + _LINKS + r""")) AS href FROM pages)
SELECT doc_id, count(href) AS resources, count(href) FILTER (WHERE regexp_matches(href, '(?i)[.](html|php)$')) AS pages FROM documents LEFT JOIN r ON doc_id = page_id GROUP BY doc_id""")
def resources_of_documents(t):
    """The resources that are found on a document's source page: one row for each document, with or without any."""
    r = t("pages").select(F.col("page_id").alias("doc_id"), F.explode(F.array_distinct(F.transform(H.links(F.col("html")), lambda x: x["href"]))).alias("href"))
    j = t("documents").select("doc_id").join(r, "doc_id", "left")
    return j.groupBy("doc_id").agg(F.count("href").alias("resources"), F.count_if(F.col("href").rlike(r"(?i)[.](html|php)$")).alias("pages"))


@query("profile_kinds", """SELECT c_custkey, c_custkey % 4 = 0 AS personal, c_custkey % 4 = 1 AS company, 'https://www.linkedin.com/company/customer' || lpad(c_custkey::VARCHAR, 9, '0') AS guess FROM customer""")
def profile_kinds(t):
    """Addresses of people, of companies, and those that only look like either."""
    k = F.col("c_custkey")
    url = F.concat(F.lit("https://www.linkedin.com/"), _cases(k, ["in/p-", "company/c-", "in/search", "company/jobs"]), F.when(k % 4 < 2, k.cast("string")).otherwise(""))
    guess = U.company_profile_guess(F.concat(F.regexp_replace("c_name", "#", "-"), F.lit(".io")))
    return t("customer").select("c_custkey", U.is_personal_profile(url).alias("personal"), U.is_company_profile(url).alias("company"), guess.alias("guess"))


_EXTRA = [
    '<a href="mailto:Info{0}@Acme.mu?subject=x">m</a><a href="mailto:x@example.com">n</a><meta name="geo.placename" content="Town {0}"><meta name="geo.region" content="MU">',
    '<a href="https://github.com/u{0}">g</a><a href="https://x.com/share?u">s</a><a href="https://www.linkedin.com/company/c{0}/">l</a><link rel="shortcut icon" href="/i{0}.png">',
    '<p>write to sales{0}@acme.mu or see pic{0}@2x.png</p><meta property="og:country-name" content="India">',
]
_EXTRA_SQL = "CASE page_id % 3 " + " ".join(f"WHEN {i} THEN replace({_rx(x)}, '{{0}}', page_id::VARCHAR)" for i, x in enumerate(_EXTRA)) + " END"


@query("page_contacts", rf"""WITH a AS (SELECT page_id, url, coalesce(html, '') || {_EXTRA_SQL} AS html FROM pages), l AS (SELECT *, {_LINKS} AS hrefs FROM a),
m AS (SELECT *, list_transform(list_filter(hrefs, lambda h: starts_with(lower(h), 'mailto:')), lambda h: lower(trim(regexp_replace(string_split(h, '?')[1], '(?i)^mailto:', '')))) AS mails FROM l)
SELECT page_id, array_to_string(list_distinct(list_filter(mails, lambda e: regexp_full_match(e, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}') AND NOT regexp_matches(e, 'example\.com|domain\.com|wixpress|sentry|github\.com')))[1:5], '|') AS contact_mails,
  array_to_string(list_sort(list_distinct(list_filter(list_concat(mails, list_filter(regexp_extract_all(lower(html), '\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z|]{{2,7}}\b'), lambda e: NOT regexp_matches(e, '\.(png|jpg|jpeg|gif|webp|svg|bmp|ico|tif|tiff|avif|mp4|mov|pdf|css|js)$'))),
    lambda e: regexp_matches(e, '@[^@]*\.[^@]*$') AND length(string_split(e, '@')[-1]) >= 4))), '|') AS page_mails,
  CASE page_id % 3 WHEN 1 THEN 'github=https://github.com/u' || page_id || '|linkedin_company=https://www.linkedin.com/company/c' || page_id || '/' ELSE '' END AS socials,
  CASE page_id % 3 WHEN 0 THEN 'Town ' || page_id END AS placename, CASE page_id % 3 WHEN 0 THEN 'MU' END AS region, CASE page_id % 3 WHEN 2 THEN 'India' END AS country,
  CASE page_id % 3 WHEN 1 THEN regexp_extract(url, '{_PARTS}', 1) || '://' || regexp_extract(url, '{_PARTS}', 2) || '/i' || page_id || '.png' END AS logo FROM m""")
def page_contacts(t):
    """Mail addresses, social profiles, place and logo in the markup of each page, which gets a footer of known contents."""
    p = t("pages").withColumn("html", F.concat(F.coalesce("html", F.lit("")), F.replace(_cases(F.col("page_id"), _EXTRA), F.lit("{0}"), F.col("page_id").cast("string"))))
    html, g = F.col("html"), H.geo(F.col("html"))
    pairs = F.transform(H.socials(html), lambda s: F.concat_ws("=", s["type"], s["url"]))
    return p.select(
        "page_id", F.array_join(H.contact_mails(html), "|").alias("contact_mails"), F.array_join(H.page_mails(F.lit(""), html), "|").alias("page_mails"), F.array_join(pairs, "|").alias("socials"),
        g["placename"].alias("placename"), g["region"].alias("region"), g["country"].alias("country"), H.logo(html, F.col("url")).alias("logo"),
    )


_COUNTRIES = ["uk", " MU ", "new land", "", "deutschland"]
_TITLES = ["Home - Firm", "Home", "Welcome to Firm", ""]


@query("customer_strings", r"""WITH c AS (SELECT c_custkey AS k, c_name, c_mktsegment AS seg FROM customer)
SELECT k AS c_custkey, ['United Kingdom', 'Mauritius', 'New Land', NULL, 'Germany'][k % 5 + 1] AS country, CASE WHEN length(k::VARCHAR) >= 3 THEN '+12' || k || '7' ELSE '+1 (2) ' || k || '-7' END AS phone,
  CASE WHEN k % 3 = 0 THEN NULL ELSE lower(seg) || k || '@x.io' END AS mail, CASE k % 4 WHEN 0 THEN 'Firm ' || k WHEN 1 THEN 'Brand' WHEN 2 THEN 'Firm ' || k ELSE 'Brand' END AS identity,
  'password=***REDACTED***&u=' || k AS secret, CASE WHEN k % 2 = 0 THEN seg ELSE c_name END AS first_one,
  CASE WHEN k % 7 = 0 THEN 'company_name must be at least 2 characters' WHEN k % 3 = 0 THEN 'domain must be a valid domain name' END AS error,
  'b|a|' || CASE WHEN lower(seg) IN ('a', 'b') THEN '' ELSE lower(seg) END AS merged, CASE WHEN k % 2 = 0 THEN 'b|d' ELSE 'a|b' END AS remaining, k % 2 = 0 AS all_seen, k % 5 = 0 AS any_one, CASE k % 5 WHEN 0 THEN 'y' ELSE 'x' END AS last_value,
  'companies/' || regexp_replace(lower(c_name), '[^a-z0-9_-]', '_', 'g') || '/' || CASE WHEN k % 2 = 0 THEN 'about_us' ELSE 'homepage' END || '.html' AS artifact, 'processed/markdown/x_io_' || k || '_q.md' AS dom,
  CASE k % 4 WHEN 0 THEN 'BLOCKED_NEEDS_ALTERNATIVE_EVIDENCE' WHEN 1 THEN 'FILTERED' ELSE 'CRAWLED_PENDING_AGENT_2' END AS route, k % 6 = 0 AS media FROM c""")
def customer_strings(t):
    """Normal forms of names, countries, numbers and addresses, sets and maps of words, paths of artefacts."""
    k, seg = F.col("c_custkey"), F.lower("c_mktsegment")
    s = k.cast("string")
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs])
    title = F.concat(_cases(k, _TITLES), F.when(k % 2 == 0, F.concat(F.lit(" "), s)).otherwise(""))
    pairs = F.array(F.struct(F.lit("k").alias("key"), F.lit("x").alias("value")), F.struct(F.when(k % 5 == 0, "k").otherwise("j").alias("key"), F.lit("y").alias("value")))
    done = F.when(k % 2 == 0, arr("a", "c")).otherwise(arr("c", "d"))
    seen = F.when(k % 2 == 0, arr("about page", "contact page")).otherwise(arr("about page"))
    return t("customer").select(
        "c_custkey", X.normalize_country(_cases(k, _COUNTRIES)).alias("country"), X.normalize_phone(F.concat(F.lit("+1 (2) "), s, F.lit("-7"))).alias("phone"),
        X.normalize_email(F.concat(F.lit(" "), "c_mktsegment", s, F.when(k % 3 == 0, "@x").otherwise("@X.io "))).alias("mail"), X.company_identity(F.lit("Brand"), title, F.lit("")).alias("identity"),
        X.sanitize_secrets(F.concat(F.lit("password=abc"), s, F.lit("&u="), s)).alias("secret"), X.first_truthy(F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise(" "), F.lit(""), F.col("c_name")).alias("first_one"),
        request_error(F.when(k % 7 == 0, "A").otherwise("Acme"), F.when(k % 3 == 0, "localhost").otherwise("www.acme.io")).alias("error"),
        F.array_join(X.ordered_union(arr("b", "a"), F.array(F.lit("a"), seg)), "|").alias("merged"), F.array_join(X.remaining(arr("a", "b", "c", "d"), done, 2, arr("none")), "|").alias("remaining"),
        X.all_types_seen(arr("about", "contact"), seen).alias("all_seen"), F.exists(F.transform(pairs, lambda p: F.concat(p["key"], p["value"])), lambda w: w == "ky").alias("any_one"), F.element_at(X.last_by_key(pairs), F.lit("k")).alias("last_value"),
        writers.artifact(F.col("c_name"), F.when(k % 2 == 0, "About Us").otherwise(""), F.lit("x"))["path"].alias("artifact"), writers.dom_path(F.concat(F.lit("https://x.io/"), s, F.lit("?q"))).alias("dom"),
        R.http_route(_cases(k, [429, 404, 200, 301]).cast("int")).alias("route"), R.media_or_blog(F.when(k % 6 == 0, "The Daily Journal").otherwise("Robots"), F.col("c_name")).alias("media"),
    )


@query("order_scores", """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders)
SELECT k AS o_orderkey, round((1 + (k % 2 = 0)::INT + (k % 3 = 0)::INT) / 11.0, 4)::DOUBLE AS completeness, round(least(1.0, 0.5 + 0.1 * (k % 2 = 0)::INT + 0.1 + 0.1 * (k % 3 = 0)::INT + 0.05), 4)::DOUBLE AS confidence, round(least(1.0, 0.5 + 0.1 * (k % 2 = 0)::INT + 0.1 + 0.1 * (k % 3 = 0)::INT + 0.05), 4) >= 0.6 AS verified,
  CASE WHEN s = 'F' THEN '' ELSE 'industry_sector|' END || 'location_region' || CASE WHEN s = 'O' THEN '' ELSE '|company_size_tier' END || '|verified_contact_email' AS open_fields,
  CASE k % 4 WHEN 0 THEN 'Mid-Market Challengers (100-1,000)' WHEN 1 THEN 'Early-Stage Startups (1-20)' WHEN 2 THEN 'Enterprise Leaders (1,000+)' ELSE 'Growth SMBs (20-100)' END AS tier, k % 3 <> 2 AS fact FROM o""")
def order_scores(t):
    """Completeness, a worker's confidence, open core fields, tier and backing of stand-in records."""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    none = F.lit(None).cast("string")
    data = F.create_map(F.lit("industry"), F.lit("x"), F.lit("products"), F.when(k % 2 == 0, "y").otherwise(""), F.lit("key_people"), F.when(k % 3 == 0, "z").otherwise(" "))
    conf = S.worker_confidence(F.lit(None).cast("double"), F.when(k % 2 == 0, "Acme").otherwise("Ac"), F.lit("u"), F.repeat(F.lit("d"), F.when(k % 3 == 0, 60).otherwise(20)), F.lit("DE"), F.lit(0.0))
    state = lambda hit: F.struct(F.lit("v").alias("value"), F.when(hit, "VERIFIED").otherwise("OPEN").alias("status"))
    phase = F.create_map(F.lit("industry_sector"), state(s == "F"), F.lit("company_size_tier"), state(s == "O"))
    tier = S.document_tier(F.when(k % 4 == 0, "mid-market"), F.when(k % 4 == 1, "startup"), F.when(k % 4 == 2, "a Fortune 500 firm").otherwise("a scaling SMB"), none)
    fact = R.valid_fact(_cases(k, ["Berlin", "Berlin, Germany", "Paris"]), F.lit("in Germany, near Berlin"), F.lit("acme.io"))
    return t("orders").select(
        "o_orderkey", F.round(S.completeness(F.map_concat(data, F.create_map(F.lit("other"), F.lit("x")))), 4).alias("completeness"), conf["confidence"].alias("confidence"), conf["verified"].alias("verified"),
        F.array_join(S.phase_gate(phase), "|").alias("open_fields"), tier.alias("tier"), fact.alias("fact"),
    )


_TIER_SQL = lambda n: f"CASE WHEN {n} <= 10 THEN 'Startup / Micro (1-10)' WHEN {n} <= 50 THEN 'Small (11-50)' WHEN {n} <= 200 THEN 'Growth SMB (51-200)' WHEN {n} <= 999 THEN 'Mid-Market (201-1000)' ELSE 'Enterprise (1000+)' END"
_BUCKET_SQL = lambda n: f"CASE WHEN {n} <= 10 THEN '1-10' WHEN {n} <= 50 THEN '11-50' WHEN {n} <= 200 THEN '51-200' WHEN {n} <= 500 THEN '201-500' WHEN {n} <= 1000 THEN '501-1000' WHEN {n} <= 5000 THEN '1001-5000' ELSE '5000+' END"


@query("prose_facts", f"""WITH d AS (SELECT doc_id, doc_id % 3 AS kind, doc_id % 900 + 1 AS n, doc_id % 70 + 1950 AS y FROM documents)
SELECT doc_id, CASE kind WHEN 0 THEN n || '+' WHEN 1 THEN n::VARCHAR ELSE n || '-' || (n + 40) END AS size, CASE kind WHEN 2 THEN {_TIER_SQL('(n + n + 40) // 2')} ELSE {_TIER_SQL('n')} END AS tier, {_BUCKET_SQL('CASE kind WHEN 2 THEN n + 40 ELSE n END')} AS bucket,
  CASE WHEN y % 2 = 0 THEN y END AS founded, CASE WHEN kind = 1 THEN 'Port Louis, Mauritius' END AS headquarters, CASE WHEN kind = 0 THEN 'Python|Docker' ELSE 'Rust' END AS technologies FROM d""")
def prose_facts(t):
    """Head count, year, seat and technologies from a statement of known contents before each whole text."""
    i, x = F.col("doc_id"), F.coalesce("text", F.lit(""))
    n, y = (i % 900 + 1).cast("string"), (i % 70 + 1950).cast("string")
    size = F.when(i % 3 == 0, F.concat(F.lit("We have more than "), n, F.lit(" employees"))).when(i % 3 == 1, F.concat(F.lit("We are a team of "), n, F.lit(" people"))).otherwise(F.concat(F.lit("We have "), n, F.lit("-"), (i % 900 + 41).cast("string"), F.lit(" people")))
    seat = F.when(i % 3 == 1, F.concat(F.lit(". Headquartered in Port Louis, Mauritius since long. "))).otherwise(". ")
    year = F.when(i % 2 == 0, F.concat(F.lit("Founded in "), y, F.lit(". "))).otherwise("")
    text = F.concat(size, seat, year, F.when(i % 3 == 0, "We use python, docker. ").otherwise("We use rust. "), x)
    d = t("documents").select("doc_id", text.alias("said"))
    said = F.col("said")
    prose = E.size_from_prose(said)
    return d.select(
        "doc_id", prose["size"].alias("size"), prose["tier"].alias("tier"), E.size_evidence(said)["bucket"].alias("bucket"), E.founded_year(said).alias("founded"), E.strict_headquarters(said).alias("headquarters"),
        F.array_join(E.tech_words(F.substring(said, 1, 120), ["Python", "Docker", "Rust"]), "|").alias("technologies"),
    )
