"""Worked cases: rules and functions over small tables of inputs, against literal results.

The queries over whole tables hold the rules against SQL that states them again; these hold them against results written by hand, with the corner
cases that the tables lack. A case is (inputs a, b, c; result as text); null results are written None.
"""

from __future__ import annotations

from collections.abc import Callable

import pytest
from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlake.functions import facts as E
from leadlake.functions import html as H
from leadlake.functions import text as X
from leadlake.functions import url as U
from leadlake.operators import filters as R
from leadlake.operators import resolution as V
from leadlake.operators import scores as S
from leadlake.sources import writers

Case = tuple[str, Callable[..., Column], list[tuple[tuple, str | None]]]


CASES: list[tuple[str, Callable[..., Column], list[tuple[tuple, str | None]]]] = []


def _register(name: str, about: str, cases: list[Case]) -> None:
    CASES.extend((f"{name[6:]}-{item}", f, own) for item, f, own in cases)


def _words(c: Column) -> Column:
    """Words of a text with bars between them, as an array."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda w: w != "")


def _joined(c: Column) -> Column:
    return F.array_join(c, "|", "-")


def _fields(c: Column, *names: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(c[n].cast("string"), F.lit("-")) for n in names])


_register("cases_urls", "The URL algebra: sites, relative addresses, brands, resources, profiles, private addresses, derived addresses.", [
    ("URL-4", lambda a, b, c: U.same_site(a, b), [(("https://blog.x.com/a", "www.x.com"), "true"), (("https://xx.com", "x.com"), "false"), (("http://x.com", "https://www.x.com/p"), "true"), (("x.com", "blog.x.com"), "false"), (("", "x.com"), "false")]),
    ("URL-5", lambda a, b, c: U.normalize(a, b), [(("/team/?utm_source=z#top", "https://x.com/a"), "https://x.com/team"), (("../b", "https://x.com/c/d/e"), "https://x.com/c/b"), (("HTTPS://X.com/Q?b=2&gclid=9&a=1", "https://x.com"), "https://x.com/Q?b=2&a=1"), (("//y.io/", "https://x.com/"), "https://y.io/"), ((" ", "https://x.com"), "https://x.com"), (("", "https://x.com"), None)]),
    ("URL-8", lambda a, b, c: U.canonical_domain(a), [(("https://www.Nihonium.io:443/a",), "nihonium.io"), (("NIHONIUM.IO",), "nihonium.io"), (("",), ""), ((None,), "")]),
    ("URL-9", lambda a, b, c: U.brand(a, {"nihonium": "Nihonium GmbH"}), [(("zero-motor_cycles.com",), "Zero Motor Cycles"), (("www.nihonium.io",), "Nihonium GmbH"), (("localhost",), "Company"), (("",), "Company")]),
    ("URL-11", lambda a, b, c: F.concat_ws("|", U.strip_www(a), U.strip_www(a, True)), [(("web.com",), "web.com|eb.com"), (("www.x.com",), "x.com|x.com"), (("wwwx.com",), "wwwx.com|x.com")]),
    ("URL-12", lambda a, b, c: _fields(U.resource(a), "type", "mime", "ending"), [(("https://x.com/a/R.PDF?v=1",), "document|application/pdf|.pdf"), (("https://x.com/l.png",), "media|image/png|.png"), (("https://x.com/feed.xml",), "web_resource|application/xml|.xml"), (("https://x.com/about",), "web_resource|text/html|.html")]),
    ("URL-13", lambda a, b, c: U.resource_name(a), [(("https://x.com/a/f.txt",), "f.txt"), (("https://x.com/",), "resource_3af30c01")]),
    ("URL-15", lambda a, b, c: F.concat_ws("|", U.is_personal_profile(a), U.is_company_profile(a)), [(("https://uk.linkedin.com/in/jane-doe",), "true|false"), (("https://linkedin.com/in/search",), "false|false"), (("https://www.linkedin.com/company/acme/",), "false|true"), (("https://www.linkedin.com/company/jobs",), "false|false"), ((None,), "false|false")]),
    ("URL-16", lambda a, b, c: U.company_profile_guess(a), [(("https://my-firm.io",), "https://www.linkedin.com/company/myfirm"), (("a.io",), None), (("home.com",), None)]),
    ("URL-17", lambda a, b, c: U.country(a), [(("https://a.co.uk/x",), "United Kingdom"), (("b.mu",), "Mauritius"), (("x.com",), None), (("localhost",), None)]),
    ("URL-18", lambda a, b, c: F.concat_ws("|", U.favicon(a), U.site_root(a), U.path_slug(a)), [(("https://www.a.io/b/c/",), "https://a.io/favicon.ico|https://www.a.io|b_c"), (("http://a.io",), "https://a.io/favicon.ico|http://a.io|homepage")]),
    ("URL-19", lambda a, b, c: U.internal_address(a), [(("169.254.169.254",), "true"), (("172.31.0.1",), "true"), (("172.32.0.1",), "false"), (("8.8.8.8",), "false"), (("999.1.1.1",), "false"), (("::1",), "true"), (("localhost",), "true"), (("x.com",), "false")]),
    ("URL-20", lambda a, b, c: U.cache_key(a, b), [(("search", "crm"), "9152d9ccb2ccd513c0f33e209cf326ba")]),
    ("FLT-11", lambda a, b, c: U.private_host(a), [(("127.0.0.1",), "true"), (("localhost",), "true"), (("192.168.1.1",), "true"), (("10.0.0.5",), "true"), (("172.16.0.1",), "true"), (("stripe.com",), "false"), (("example.org",), "false")]),
    ("JOIN-14", lambda a, b, c: U.same_site(a, b), [(("https://a.b.x.com/p", "https://b.x.com/"), "true"), (("https://b.x.com", "https://a.b.x.com"), "false")]),
])

_register("cases_strings", "Strings, numbers, arrays and maps: names, countries, phones, mails, secrets, titles, sentences, chunks of words.", [
    ("STRF-1", lambda a, b, c: X.normalize_string(a), [(("  a &amp;\n b&nbsp;&lt;c&gt; ",), "a & b <c>"), (("Bob&#39;s &#8217;&#x41;",), "Bob's ’A"), (("&amp;lt;",), "&lt;"), (("&amp;#39;",), "&#39;"), (("  ",), None)]),
    ("STRF-3", lambda a, b, c: X.normalize_country(a), [(("uk",), "United Kingdom"), ((" MU ",), "Mauritius"), (("new land",), "New Land"), (("",), None)]),
    ("STRF-4", lambda a, b, c: X.normalize_phone(a), [(("+1 (2) 34567",), "+1234567"), ((" 12-34 ",), "12-34")]),
    ("STRF-5", lambda a, b, c: X.normalize_email(a), [((" A@B.co ",), "a@b.co"), (("a@b",), None), (("a b@c.io",), None)]),
    ("STRF-6", lambda a, b, c: X.company_key(a), [(("Acme Corp.",), "acme"), (("Stripe, Inc.",), "stripe"), (("OpenAI LLC",), "openai"), (("Google UK Limited",), "google uk")]),
    ("STRF-7", lambda a, b, c: X.company_identity(b, a, c), [(("Home - Nihonium", "Brand"), "Nihonium"), (("Home", "Brand"), "Brand"), (("Welcome to Acme | Tools", "Brand"), "Acme"), (("", "Brand", "Globex – Login"), "Globex")]),
    ("STRF-9", lambda a, b, c: X.sanitize_secrets(a), [(("password=abc&x",), "password=***REDACTED***&x"), (("postgresql://u:pw@h",), "postgresql://u:***REDACTED***@h"), (("Auth: Bearer q.r.s",), "Auth: Bearer ***REDACTED***"), (("plain",), "plain")]),
    ("STRF-10", lambda a, b, c: E.executive_title(a), [(("Founder & CEO",), "Co-Founder & CEO"), (("co-founder",), "Co-Founder"), (("Director",), "Chief Technology Officer"), (("Chief Operating Officer",), "Chief Operating Officer"), (("vp sales",), "Vice President"), (("head of growth",), "Head Of Growth"), (("Managing Partner",), "Managing Partner"), (("gardener",), None)]),
    ("STRF-12", lambda a, b, c: E.person_name_ok(a, b), [(("Jane Doe", "Acme"), "true"), (("Acme Jane", "Acme"), "false"), (("About Us", "Acme"), "false"), (("jane doe", "Acme"), "false"), (("Jane", "Acme"), "false"), (("Jean-Luc O'Neill", "Acme"), "true")]),
    ("STRF-14", lambda a, b, c: F.concat_ws("|", X.words_regex(a), X.words_split(a)), [(("it's a test",), "4|3"), (("",), "0|0"), ((None,), "0|0")]),
    ("STRF-15", lambda a, b, c: H.preview(a), [(("<style>p{}</style><p>One <b>two</b></p><script>x</script> three",), "One two three")]),
    ("STRF-16", lambda a, b, c: X.overview(a, b, c), [(("We build useful tools for many people.", "", "Acme"), "We build useful tools for many people."), (("short", "Read about our cookie policy on this page. We make robots that sort parcels. They run at night in two halls. More follows in the end.", "Acme"), "We make robots that sort parcels. They run at night in two halls."), (("", "", "Acme"), "Acme is an organisation with a public web presence.")]),
    ("STRF-18", lambda a, b, c: X.sanitize_query(a), [(("  crm tools ",), "crm tools"), (("warez site",), None), (("ab",), None)]),
    ("STRF-23", lambda a, b, c: _joined(V.recrawl_paths(_words(a), _words(b))), [(("location_region|company_size_tier", "/contact"), "/locations|/about|/careers"), (("x", ""), "/about|/contact")]),
    ("PRJ-3", lambda a, b, c: X.first_truthy(a, b, c), [((" ", "", "z"), "z"), ((None, "y", "z"), "y"), ((None, " ", None), None)]),
    ("FLT-10", lambda a, b, c: _request(a, b), [(("A", "x.io"), "company_name must be at least 2 characters"), (("Acme", "localhost"), "domain must be a valid domain name"), ((" Acme ", "www.acme.io"), None), (("x" * 201, "x.io"), "company_name must be under 200 characters")]),
    ("SET-1", lambda a, b, c: _joined(X.ordered_union(_words(a), _words(b))), [(("b|a", "a|c"), "b|a|c"), (("", "x"), "x")]),
    ("SET-3", lambda a, b, c: _joined(X.remaining(_words(a), _words(b), 2, F.array(F.lit("none")))), [(("a|b|c|d", "b"), "a|c"), (("a", "a"), "none")]),
    ("SET-4", lambda a, b, c: X.all_types_seen(_words(a), _words(b)), [(("about|contact", "about page|contact page"), "true"), (("about|contact", "about page"), "false"), (("", "x"), "true")]),
    ("MATH-7", lambda a, b, c: X.number(a), [(("1,234",), "1234"), (("12",), "12"), (("x",), None)]),
    ("MATH-8", lambda a, b, c: X.digits(a), [(("about 12 x 3",), "123"), (("none",), "0")]),
    ("ARR-2", lambda a, b, c: _joined(F.transform(F.split(a, r"\s*,\s*"), lambda x: F.trim(x))), [(("a, b ,c",), "a|b|c"), (("one",), "one")]),
    ("ARR-5", lambda a, b, c: F.concat_ws("|", F.exists(_words(a), lambda w: w == b), F.forall(_words(a), lambda w: w == b)), [(("x|y", "x"), "true|false"), (("x|x", "x"), "true|true"), (("", "x"), "false|true")]),
    ("MAP-1", lambda a, b, c: X.label(a, {"CP-04": "SEARCH", "CP-18": "CRAWL"}, "SYSTEM"), [(("CP-04",), "SEARCH"), (("CP-99",), "SYSTEM")]),
    ("MAP-2", lambda a, b, c: F.to_json(X.last_by_key(F.transform(_words(a), lambda w: F.struct(F.substring_index(w, "=", 1).alias("key"), F.substring_index(w, "=", -1).alias("value"))))), [(("k=1|j=2|k=3",), '{"k":"3","j":"2"}')]),
    ("JSON-2", lambda a, b, c: F.to_json(X.merge_maps(F.from_json(a, "map<string,string>"), F.from_json(b, "map<string,string>"))), [(('{"a":"1","b":"2"}', '{"b":"3","c":"4"}'), '{"a":"1","b":"3","c":"4"}')]),
    ("SNK-2", lambda a, b, c: writers.artifact(a, b, c)["path"], [(("Acme Robotics!", "About Us", "x"), "companies/acme_robotics_/about_us.html"), (("acme", "", "x"), "companies/acme/homepage.html")]),
    ("SNK-3", lambda a, b, c: writers.dom_path(a), [(("https://x.com/a?b",), "processed/markdown/x_com_a_b.md"), (("http://" + "y" * 100,), "processed/markdown/" + "y" * 80 + ".md")]),
])


def _request(name: Column, domain: Column) -> Column:
    from leadlake.operators.relational import request_error

    return request_error(name, domain)


_PAGE = (
    '<html lang="en"><head><title>Acme</title><meta name="description" content="Robots for parcels"><link rel="canonical" href="/home/"><link rel="shortcut icon" href="/i.png">'
    '<meta name="geo.placename" content="Port Louis"><meta name="geo.region" content="MU"></head><body><h1>Acme robots</h1><a href="https://www.linkedin.com/company/acme-mu">in</a><a href="https://x.com/share?u">s</a>'
    '<a href="https://twitter.com/acme">t</a><a href="https://github.com/acme">g</a><a href="/company/one">1</a><a href="https://other.io/">o</a><a href="mailto:Hi@acme.mu?x=1">m</a><a href="mailto:x@example.com">n</a>'
    '<img class="site-logo" src="/l.png" alt="L"></body></html>'
)

_register("cases_pages", "Facts of a page's HTML, and of prose on it.", [
    ("HTML-2", lambda a, b, c: H.description(a), [((_PAGE,), "Robots for parcels"), (('<meta name="description" content="x">',), None), (('<meta property="og:description" content="A long text">',), "A long text")]),
    ("HTML-3", lambda a, b, c: F.concat_ws("|", H.canonical(a, b), H.language(a)), [((_PAGE, "https://acme.mu/x"), "https://acme.mu/home|en"), (("<p>", "https://b.de/"), "https://b.de/")]),
    ("HTML-5", lambda a, b, c: _fields(H.geo(a), "region", "placename", "country"), [((_PAGE,), "MU|Port Louis|-"), (('<meta property="og:country-name" content="India">',), "-|-|India")]),
    ("HTML-7", lambda a, b, c: _joined(H.contact_mails(a)), [((_PAGE,), "hi@acme.mu"), (("<p>",), "")]),
    ("HTML-8", lambda a, b, c: _joined(H.page_mails(a, b)), [(("see b@acme.mu and pic@2x.png", _PAGE), "b@acme.mu|hi@acme.mu|x@example.com"), (("none", "<p>"), "")]),
    ("HTML-9", lambda a, b, c: _joined(F.transform(H.socials(a), lambda s: F.concat_ws("=", s["type"], s["url"]))), [((_PAGE,), "linkedin_company=https://www.linkedin.com/company/acme-mu|twitter=https://twitter.com/acme|github=https://github.com/acme")]),
    ("HTML-11", lambda a, b, c: H.logo(a, b), [((_PAGE, "https://acme.mu/x"), "https://acme.mu/i.png"), (('<img alt="Our logo" src="l.svg">', "https://b.de/p/q"), "https://b.de/p/l.svg"), (("<p>", "https://b.de/"), None)]),
    ("HTML-13", lambda a, b, c: _joined(F.transform(E.people(a, b, c), lambda p: F.concat_ws("=", p["name"], p["title"], p["source"]))), [
        (("we met. Jane Doe, CEO of it. CTO: John Smith. and Jane Doe - Founder. About Us, Director", '<a href="https://www.linkedin.com/in/mary-major-12">x</a>', "Acme"), "Jane Doe=Chief Executive Officer=page_text|John Smith=Chief Technology Officer=page_text|Mary Major=Executive / Leadership=profile_link")]),
    ("HTML-14", lambda a, b, c: _joined(H.listed(a, b)), [((_PAGE, "https://acme.mu/x"), "https://acme.mu/company/one|https://other.io/")]),
    ("TXT-3", lambda a, b, c: _fields(E.size_from_prose(a), "size", "tier"), [(("more than 2,000 employees",), "2000+|Enterprise (1000+)"), (("a team of 35",), "35|Small (11-50)"), (("operates 35 supermarkets",), "35 locations (~1,000+ staff)|Enterprise (1000+)"), (("nothing",), "Unknown|Unknown")]),
    ("TXT-4", lambda a, b, c: E.size_evidence(a)["bucket"], [(("we have 51-200 employees here",), "51-200"), (("headcount: 7",), "1-10"), (("over 6,000 people",), "5000+"), (("nothing",), None)]),
    ("TXT-5", lambda a, b, c: E.headquarters(a), [(("Headquarters: Berlin, Germany. More",), "Berlin, Germany"), (("no place",), None)]),
    ("TXT-6", lambda a, b, c: E.city(a, {"port louis": "Port Louis, Mauritius", "berlin": "Berlin, Germany"}), [(("offices in Berlin and Port Louis",), "Port Louis, Mauritius"), (("Berliner",), None)]),
    ("TXT-7", lambda a, b, c: V.inferred_location(a, b), [(("https://x.com", "our Berlin team"), "Berlin, Germany"), (("https://x.mu", ""), "Mauritius"), (("https://x.com", ""), "Unknown")]),
    ("TXT-8", lambda a, b, c: _joined(E.tech_stack(a)), [(("react and docker",), "React.js|Docker"), (("zzz",), "Web Infrastructure")]),
    ("TXT-9", lambda a, b, c: _joined(E.tech_words(a, ["Go", "Python"])), [(("we use go, python",), "Go|Python"), (("ergo mango",), "")]),
    ("TXT-12", lambda a, b, c: E.strict_headquarters(a), [(("Headquartered in Port Louis, Mauritius since 2001",), "Port Louis, Mauritius"), (("based in May Cookie",), None)]),
    ("TXT-14", lambda a, b, c: E.founded_year(a), [(("Founded in 1998 by",), "1998"), (("Est. 2004",), "2004"), (("year 1998",), None)]),
    ("TXT-16", lambda a, b, c: _fields(E.search_person(a, b, c), "name", "role"), [(("Jane Doe - CEO - Acme | LinkedIn", "", "https://linkedin.com/in/jane-doe"), "Jane Doe|CEO"), (("", "Founder of Acme", "https://linkedin.com/in/john-smith-9"), "John Smith|Founder")]),
    ("TXT-17", lambda a, b, c: E.company_profile(a, b), [(('<a href="https://linkedin.com/company/jobs"><a href="https://www.linkedin.com/company/Acme-X">', ""), "https://www.linkedin.com/company/acme-x"), (("", "see https://linkedin.com/school/mit"), "https://www.linkedin.com/school/mit"), (("", ""), None)]),
    ("TXT-18", lambda a, b, c: E.relevance(a, F.lit(""), b, F.lit("acme.io"), F.lit("Acme")), [(("about acme.io", "https://z.com"), "high"), (("Jane at Acme!", "https://linkedin.com/in/j"), "medium"), (("Acmes", "https://linkedin.com/in/j"), None)]),
])

_SECTORS = {"Retail, Supermarkets & E-Commerce": ["store", "club card"], "Software, SaaS & Cloud Computing": ["software", "api"]}


def _entity(a: Column, b: Column, c: Column) -> Column:
    return R.filter_entity(a, b, F.coalesce(c.cast("double"), F.lit(0.9)))["rule_id"]


def _person(name: Column, role: Column, evidence: Column, profile: Column | None = None, page: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return _fields(S.person_match(name, role, F.lit("Acme"), F.lit("acme.io"), evidence, none if profile is None else profile, none, none if page is None else page), "status", "score")


_LI = "https://www.linkedin.com/in/jane-doe"

_register("cases_rules", "The rule ladders for entities, candidates, facts and pages.", [
    ("RULE-3", _entity, [
        (("", "https://x.io"), "MISSING"), (("ab", "https://x.io"), "SHORT"), (("12345", "https://x.io"), "NO_LETTER"), (("deadbeef42", "https://x.io"), "HEX"), (("What is a CRM?", "https://x.io"), "QUESTION"),
        (("12 best tools for teams", "https://x.io"), "LISTICLE"), (("Sign in to Portal", "https://x.io"), "ARTICLE"), (("A name that goes on for far too many words", "https://x.io"), "SENTENCE"),
        (("Breaking News", "https://x.io"), "NEWS"), (("How to sell", "https://x.io"), "GUIDE"), (("untitled", "https://x.io"), "JUNK"), (("Acme", "https://x.io", "0.1"), "CONFIDENCE"), (("Acme", ""), "NO_URL"),
        (("Acme", "ftp://x.io"), "SCHEME"), (("Acme", "https://undefined"), "JUNK_URL"), (("Acme Robotics", "https://x.io"), "OK")]),
    ("RULE-4", lambda a, b, c: _fields(R.qualify(a, b, c), "qualified", "rule_id", "company_size", "priority"), [
        (("Acme", "We have 50-120 employees", "https://acme.io"), "true|OK|50-120|HIGH"), (("Acme", "a startup", "https://acme.io"), "true|OK|UNKNOWN (Startup Indicator)|HIGH"), (("Acme", "robots", "https://acme.io"), "true|OK|UNKNOWN|NORMAL"),
        (("Acme", "Fortune 500 firm", "https://acme.io"), "false|LARGE_ENTERPRISE|>200|DEPRIORITIZED"), (("Acme", "has 1,200 employees", "https://acme.io"), "false|LARGE_ENTERPRISE|>200|DEPRIORITIZED"),
        (("Cup", "football fixtures today", "https://acme.io"), "false|SPORTS_MEDIA|UNKNOWN|REJECTED"), (("Board", "ministry of trade", "https://acme.io"), "false|GOVERNMENT_AGENCY|UNKNOWN|REJECTED"),
        (("Pies", "a pizza chain", "https://acme.io"), "false|FRANCHISE_CHAIN|>200|DEPRIORITIZED"), (("Help", "x", "https://support.acme.io"), "false|SUBDOMAIN_RESOURCE|UNKNOWN|REJECTED")]),
    ("RULE-2", lambda a, b, c: R.filter_content(a, b, c.cast("int"))["rule_id"], [(("few words", "Title", "2"), "THIN"), (("text", None, "20"), "NO_TITLE"), (("this domain is for sale", "Title", "20"), "SPAM"), (("Just a moment... Cloudflare", "Title", "20"), "CHALLENGE"), (("text", "404 page", "20"), "ERROR_TITLE"), (("text", "Acme", "20"), "OK")]),
    ("RULE-10", lambda a, b, c: R.valid_fact(a, b, c), [(("Berlin", "our Berlin office", "acme.io"), "true"), (("Berlin, Germany", "in Germany, near Berlin", "acme.io"), "true"), (("Paris", "our Berlin office", "acme.io"), "false"), (("acme", "acme is here", "www.acme.io"), "false"), (("unknown", "unknown", "acme.io"), "false"), (("Berlin", "", "acme.io"), "false")]),
    ("RULE-12", lambda a, b, c: R.media_or_blog(a, b), [(("The Daily Journal", ""), "true"), (("Acme", "our robots"), "false"), (("Acme", "welcome to my blog"), "true")]),
    ("RULE-13", lambda a, b, c: R.http_route(a.cast("int")), [(("403",), "BLOCKED_NEEDS_ALTERNATIVE_EVIDENCE"), (("429",), "BLOCKED_NEEDS_ALTERNATIVE_EVIDENCE"), (("404",), "FILTERED"), (("200",), "CRAWLED_PENDING_AGENT_2")]),
    ("RULE-16", lambda a, b, c: R.headquarters_or_null(a), [(("Berlin, Germany",), "Berlin, Germany"), (("a1b2c3d4e5f6g7 x",), None), (("Berlin",), None)]),
    ("RULE-17", lambda a, b, c: S.document_tier(a, b, c, F.lit("u")), [(("mid-market", None, ""), "Mid-Market Challengers (100-1,000)"), ((None, "startup", ""), "Early-Stage Startups (1-20)"), ((None, None, "a Fortune 500 global leader"), "Enterprise Leaders (1,000+)"), ((None, None, "a scaling SMB"), "Growth SMBs (20-100)")]),
    ("RULE-18", lambda a, b, c: S.company_tier(a, b.cast("int")), [(("50-200", "5"), "Growth SMB (51-200)"), ((None, "1500"), "Enterprise Leaders (1,000+)"), ((None, "25"), "Growth SMBs (20-100)"), (("", "3"), "Early-Stage Startups (1-20)")]),
    ("RULE-8", lambda a, b, c: R.classify_url(a), [(("https://www.g2.com/categories/crm",), "listing"), (("https://www.linkedin.com/company/acme/",), "entity"), (("https://acme.io",), "unknown")]),
    ("RULE-6", lambda a, b, c: R.moderation_route(R.moderate(a, b.cast("double"))), [(("online casino", None), "QUARANTINE_AND_BLOCK"), (("robots", "0.5"), "REVIEW_QUEUE"), (("robots", "0.1"), "PASS"), (("robots", "0.9"), "QUARANTINE_AND_BLOCK"), (("robots", None), "QUARANTINE_AND_BLOCK")]),
    ("RULE-5", lambda a, b, c: R.disallowed_category(a), [(("Sussex fair",), "adult"), (("casino night",), "gambling"), (("crack and casino",), "gambling"), (("robots",), None)]),
])

_register("cases_scores", "The scoring models: people, companies, sectors, cards, completeness.", [
    ("SCORE-1", lambda a, b, c: _fields(E.classify_sector(a, b, c, _SECTORS), "sector", "sub", "confidence"), [
        (("https://a.com/api", "The API", "api api store"), "Software, SaaS & Cloud Computing|Corporate|0.92"), (("https://x.store/", "", ""), "Retail, Supermarkets & E-Commerce|Corporate|0.98"), (("https://u.edu/", "", ""), "Education & EdTech|Higher Education|0.85"),
        (("https://u.com/", "", ""), "Professional, Legal & Business Services|Commercial Enterprise|0.5")]),
    ("SCORE-2", lambda a, b, c: _person(a, F.lit("CEO"), b, c), [(("Jane Doe", "Jane Doe acme.io", _LI), "VERIFIED|0.9"), (("Jo", "acme.io", None), "REJECTED|0.0"), (("Jane Doe", "a recipe acme.io", None), "REJECTED|0.05"), (("Jane Doe", "works at Lumo", _LI), "REJECTED|0.15"), (("Jane Doe", "CEO at Lumo. Acme partner", _LI), "REVIEW|0.6"), (("Jane Doe", "nothing", _LI), "REJECTED|0.4")]),
    ("SCORE-3", lambda a, b, c: _fields(S.candidate_match(F.struct(F.lit("VERIFIED").alias("status"), F.lit(0.9).alias("score")), a, F.lit("Jane Doe"), b), "status", "score", "is_leadership"), [((_LI, "CEO"), "VERIFIED|0.9|true"), (("https://linkedin.com/jobs", "Partner"), "REJECTED|0.0|true"), ((_LI, "Gardener"), "VERIFIED|0.9|false")]),
    ("SCORE-4", lambda a, b, c: _fields(S.company_match(a, b, _words(c), F.lit(True), F.array(F.lit("m@acme.io")), F.array().cast("array<string>")), "status", "score"), [(("acme.io", "Acme", "https://acme.io/a|https://b.io"), "VERIFIED|0.93"), (("", "Acme", ""), "MISMATCH|0.2"), (("acme.io", "Home", "https://acme.io"), "MISMATCH|0.2")]),
    ("SCORE-8", lambda a, b, c: S.quality(a, b, F.lit("Software"), c, _words(F.lit("a|b")), F.lit("Berlin"), F.lit("11-50"), _words(F.lit("J D|K L")), _words(F.lit("a@x.io"))), [(("Acme", "tools.io", "x" * 45), "100"), (("Acme", "acme.io", "x" * 20), "93"), (("unknown", "x.io", ""), "70")]),
    ("SCORE-9", lambda a, b, c: F.round(S.completeness(F.from_json(a, "map<string,string>")), 4), [(('{"industry":"x","products":""}',), "0.0909"), (("{}",), "0.0")]),
    ("SCORE-10", lambda a, b, c: _fields(S.worker_confidence(a.cast("double"), b, F.lit("u"), F.repeat(F.lit("d"), 60), c, F.lit(0.0)), "confidence", "verified"), [(("0.5", "Acme", "DE"), "0.85|true"), ((None, "Ac", None), "0.7|true"), (("0.1", "Ac", None), "0.3|false")]),
    ("SCORE-14", lambda a, b, c: _joined(S.phase_gate(F.from_json(a, "map<string,struct<value:string,status:string>>"))), [(('{"industry_sector":{"value":"x","status":"VERIFIED"}}',), "location_region|company_size_tier|verified_contact_email"), (("{}",), "industry_sector|location_region|company_size_tier|verified_contact_email")]),
    ("SCORE-15", lambda a, b, c: _fields(V.resolve_record(F.from_json(a, "map<string,string>"), F.struct(F.lit(None).cast("string").alias("formatted"), b.alias("country")), c, F.lit(None).cast("string"), F.array().cast("array<string>"), F.lit("Software")), "country", "company_size", "company_tier", "industry"), [
        (('{"company_size":"1000+"}', None, ""), "United States|1000+|Enterprise (1000+)|Software"), (("{}", "Germany", "a team of 35"), "Germany|35|Small (11-50)|Software"), (('{"industry":"Robots","country":"uk"}', None, ""), "United Kingdom|Unknown|Unknown|Robots")]),
])


@pytest.mark.parametrize("item,f,own", CASES, ids=[c[0] for c in CASES])
def test_case(spark, item, f, own):
    rows = [(n, *(*args, None, None)[:3]) for n, (args, _) in enumerate(own)]
    got = spark.createDataFrame(rows, "n int, a string, b string, c string").select("n", f(F.col("a"), F.col("b"), F.col("c")).cast("string").alias("result")).orderBy("n").collect()
    assert [r.result for r in got] == [want for _, want in own]
