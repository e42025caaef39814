"""Column functions on tables of cases: value in, value out."""

import pytest
from pyspark.sql import functions as F

from leadlake.functions import facts as E
from leadlake.functions import html as H
from leadlake.functions import text as X
from leadlake.functions import url as U


def out(spark, expr, *values):
    names = "abcdefgh"[: len(values)]
    schema = ", ".join(f"{n} {'string' if not isinstance(v, list) else 'array<string>'}" for n, v in zip(names, values, strict=True))
    df = spark.createDataFrame([tuple(values)], schema)
    return df.select(expr(*[F.col(n) for n in names]).alias("x")).first()["x"]


CASES = [
    (X.company_key, "Acme Corp.", "acme"), (X.company_key, "Stripe, Inc.", "stripe"), (X.company_key, "OpenAI LLC", "openai"), (X.company_key, "Google UK Limited", "google uk"),
    (U.private_host, "127.0.0.1", True), (U.private_host, "localhost", True), (U.private_host, "192.168.1.1", True), (U.private_host, "10.0.0.5", True), (U.private_host, "172.16.0.1", True),
    (U.private_host, "stripe.com", False), (U.private_host, "example.org", False),
    (U.internal_address, "169.254.169.254", True), (U.internal_address, "8.8.8.8", False), (U.internal_address, "::1", True), (U.internal_address, "999.1.1.1", False),
    (U.host, "HTTPS://User.Example.COM:8080/x", "user.example.com"), (U.host, "example.com/a?b", "example.com"), (U.host, "http://a.b#c", "a.b"),
    (U.registrable_domain, "www.shop.example.co.uk", "example.co.uk"), (U.registrable_domain, "a.b.example.com", "example.com"), (U.registrable_domain, "example.com", "example.com"), (U.registrable_domain, "co.uk", "co.uk"),
    (U.root_domain, "https://sub.example.com/x", "example.com"), (U.root_domain, "a.b.com.au", "b.com.au"), (U.root_domain, "localhost", "localhost"), (U.root_domain, "http://www.x.ac.uk:80/", "x.ac.uk"),
    (U.normalize, " HTTP://WWW.Ex.com/a/b//?utm_source=x&q=1&e=&gclid=2#frag ", "http://www.ex.com/a/b?q=1"), (U.normalize, "http://x.com/", "http://x.com/"), (U.normalize, "", None), (U.normalize, None, None),
    (U.brand, "https://www.nihonium.io/", "Nihonium"), (U.brand, "zero-motorcycles.com", "Zero Motorcycles"), (U.brand, "localhost", "Company"), (U.brand, "", "Company"),
    (U.canonical_domain, "nihonium.io:443", "nihonium.io"), (U.canonical_domain, "https://www.nihonium.io/", "nihonium.io"), (U.canonical_domain, None, ""),
    (U.country, "https://a.co.uk/x", "United Kingdom"), (U.country, "x.com", None), (U.is_personal_profile, "https://uk.linkedin.com/in/jane-doe", True), (U.is_personal_profile, "https://linkedin.com/in/search", False), (U.is_personal_profile, None, False),
    (U.is_company_profile, "https://www.linkedin.com/company/acme/", True), (U.is_company_profile, "https://www.linkedin.com/company/jobs", False),
    (U.company_profile_guess, "https://my-firm.io", "https://www.linkedin.com/company/myfirm"), (U.company_profile_guess, "a.io", None), (U.path_slug, "http://x.com/a/b/", "a_b"), (U.path_slug, "http://x.com", "homepage"),
    (U.artifact_slug, "My Page!", "my_page_"), (U.artifact_slug, "", "homepage"), (U.ending, "http://x/a/File.PDF?x", ".pdf"), (U.resource_name, "http://x/a/f.txt", "f.txt"), (U.favicon, "www.a.io", "https://a.io/favicon.ico"),
    (lambda c: U.strip_www(c), "web.com", "web.com"), (lambda c: U.strip_www(c, True), "web.com", "eb.com"),
    (X.normalize_string, "  a &amp;\n b&nbsp;&lt;c&gt; ", "a & b <c>"), (X.normalize_string, "   ", None), (X.normalize_string, "&amp;lt;", "&lt;"), (X.normalize_string, "Bob&#39;s &#8217;&#x1F600;&#38;lt; &#xD800;&amp;#39;", "Bob's \u2019\U0001F600&lt; &#xD800;&#39;"), (X.normalize_language, "EN-gb", "en"), (X.normalize_country, "uk", "United Kingdom"), (X.normalize_country, "new land", "New Land"),
    (X.normalize_phone, "+1 (2) 34567", "+1234567"), (X.normalize_phone, "12-34", "12-34"), (X.normalize_email, " A@B.co ", "a@b.co"), (X.normalize_email, "a@b", None),
    (X.sanitize_secrets, "password=abc&x", "password=***REDACTED***&x"), (X.sanitize_secrets, "postgresql://u:pw@h", "postgresql://u:***REDACTED***@h"), (X.sanitize_query, "  crm tools ", "crm tools"), (X.sanitize_query, "warez site", None), (X.sanitize_query, "ab", None),
    (X.words_regex, "it's a test", 4), (X.words_split, " it's  a test ", 3), (X.words_split, None, 0), (X.number, "1,234", 1234), (X.digits, "about 12 x 3", 123), (X.digits, "none", 0),
    (E.standard_tier, "50-200", "Growth SMB (51-200)"), (E.standard_tier, "1000+", "Enterprise (1000+)"), (E.standard_tier, "2,500", "Enterprise (1000+)"), (E.standard_tier, "unknown", "Unknown"), (E.standard_tier, "Small (11-50)", "Small (11-50)"), (E.standard_tier, "many", "Unknown"),
    (lambda c: E.size_from_prose(c)["size"], "more than 2,000 employees", "2000+"), (lambda c: E.size_from_prose(c)["size"], "50-200 employees", "200"), (lambda c: E.size_from_prose(c)["tier"], "a team of 35", "Small (11-50)"),
    (lambda c: E.size_from_prose(c)["size"], "operates 35 supermarkets", "35 locations (~1,000+ staff)"), (lambda c: E.size_from_prose(c)["tier"], "nothing", "Unknown"),
    (lambda c: E.size_evidence(c)["bucket"], "we have 51-200 employees here", "51-200"), (lambda c: E.size_evidence(c)["bucket"], "headcount: 7", "1-10"), (lambda c: E.size_evidence(c)["bucket"], "nothing", None),
    (E.headquarters, "Headquarters: Berlin, Germany. More", "Berlin, Germany"), (E.country_in, "made in germany", "Germany"), (E.founded_year, "Founded in 1998 by", 1998), (E.founded_year, "year 1998", None), (E.phone, "call +49 30 1234567 now", "+49 30 1234567"), (E.phone, "call 12", None),
    (E.tech_stack, "react and docker", ["React.js", "Docker"]), (E.tech_stack, "zzz", ["Web Infrastructure"]), (E.prose_mails, "a@x.io b@example.com a@x.io", ["a@x.io"]),
    (E.executive_title, "Founder & CEO", "Co-Founder & CEO"), (E.executive_title, "Director", "Chief Technology Officer"), (E.executive_title, "vp sales", "Vice President"), (E.executive_title, "head of growth", "Head Of Growth"), (E.executive_title, "gardener", None), (E.executive_title, "co-founder", "Co-Founder"),
    (H.title, "<title> A &amp; B </title>", "A & B"), (H.title, '<meta property="og:title" content="OG"><title>T</title>', "OG"), (H.title, "<h1>Only <b>this</b></h1>", "Only this"), (H.title, "<p>x</p>", None),
    (H.description, '<meta content="A long text" name="description">', "A long text"), (H.description, '<meta name="description" content="x">', None), (H.language, '<html lang="de-AT">', "de"),
    (H.clean_text, "<head><title>t</title></head><p>a<script>var x='</p>';</script> b</p><!-- c -->d", "a b d"), (H.contact_mails, '<a href="mailto:Info@Firm.io?x=1">m</a><a href="mailto:x@example.com">n</a>', ["info@firm.io"]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_case(spark, case):
    f, value, want = CASES[case]
    assert out(spark, f, value) == want


def test_two_arguments(spark):
    assert out(spark, U.same_site, "https://blog.x.com/a", "www.x.com") is True
    assert out(spark, U.same_site, "https://xx.com", "x.com") is False
    assert out(spark, U.normalize, "../a", "http://x.com/b/c") == "http://x.com/a"
    assert [out(spark, U.resolve, u, "https://x.com/b/c/d?q#f") for u in ("../../../z", "./e/../g?y=1", "..", "/a/./b/../c", "k")] == ["https://x.com/z", "https://x.com/b/c/g?y=1", "https://x.com/b/", "https://x.com/a/c", "https://x.com/b/c/k"]
    assert out(spark, U.normalize, "//y.com/z/", "https://x.com/b") == "https://y.com/z"
    assert out(spark, U.normalize, "?q=1", "https://x.com/b?z=2") == "https://x.com/b?q=1"
    assert [out(spark, U.link_score, u, t) for u, t in (("/x", "Our team"), ("/cart", ""), ("/x", "y"))] == [0, 2, 1]
    assert out(spark, X.first_truthy, " ", "b") == "b"
    assert out(spark, lambda a, b: F.array_join(X.ordered_union(a, b), ","), ["a", "b"], ["b", "c"]) == "a,b,c"
    assert out(spark, lambda a, b: X.all_types_seen(a, b), ["x"], ["my x page"]) is True
    assert out(spark, E.person_name_ok, "Jane Doe", "Acme") is True
    assert out(spark, E.person_name_ok, "Acme Jane", "Acme") is False
    assert out(spark, E.person_name_ok, "About Us", "Acme") is False
    assert out(spark, lambda a, b: E.own_mails(a, b), "x@firm.io y@other.io", "firm.io") == ["x@firm.io"]
    assert out(spark, lambda t, b: X.company_identity(b, t, F.lit(None)), "Home - Nihonium", "Brand") == "Nihonium"
    assert out(spark, lambda t, b: X.company_identity(b, t, F.lit(None)), "Home", "Brand") == "Brand"
    assert out(spark, lambda t, b: X.company_identity(b, t, F.lit(None)), "Welcome to Acme | Tools", "Brand") == "Acme"


def test_subdomains(spark):
    s = {u: out(spark, U.subdomain, u) for u in ("https://help.x.co.uk/a", "x.com", "https://tw.x.com", "https://app.x.com", "https://my-blog.x.com", "auth.y.io")}
    assert [(v.root, v.subdomain, v.kind) for v in s.values()] == [("x.co.uk", "help", "SUPPORT"), ("x.com", "", None), ("x.com", "tw", "LANGUAGE_TOOL"), ("x.com", "app", None), ("x.com", "my-blog", "CONTENT_RESOURCE"), ("y.io", "auth", "AUTH_INFRASTRUCTURE")]


PAGE = """<html lang="en"><head><title>Acme</title><link rel="canonical" href="/home/"><link rel="shortcut icon" href="/i.png">
<meta name="geo.placename" content="Port Louis"><script type="application/ld+json">{"@graph":[{"@type":"WebSite"},{"@type":["Organization"],"email":"mailto:hi@acme.mu",
"address":{"addressLocality":"Ebene","addressCountry":{"name":"mu"}},"numberOfEmployees":{"minValue":12}}]}</script><script type="application/ld+json">{broken</script></head>
<body><a href="https://www.linkedin.com/company/acme-mu">in</a><a href="https://x.com/share?u">s</a><a href="https://twitter.com/acme">t</a><a href="https://github.com/acme">g</a>
<a href="/company/one">1</a><a href="https://other.io/">o</a><a href="https://other.io/">o</a><a href="#x">x</a><a href="mailto:a@acme.mu">m</a><img class="site-logo" src="/l.png" alt="L"></body></html>"""


def test_page_facts(spark):
    df = spark.createDataFrame([(PAGE, "https://acme.mu/x"), ("", "https://b.de/"), (None, None)], "html string, url string")
    h, u = F.col("html"), F.col("url")
    df = df.withColumn("ld", H.json_ld()(h))
    a, b, c = df.select(H.canonical(h, u).alias("canonical"), "ld", H.location(F.col("ld"), h, u).alias("place"), H.socials(h).alias("socials"), H.listed(h, u).alias("listed"), H.logo(h, u).alias("logo"), H.contact_mails(h, F.col("ld.mails")).alias("mails"), H.page_mails(F.lit("see b@acme.mu and pic@2x.png"), h).alias("found"), F.size(H.links(h)).alias("n")).collect()
    assert a.canonical == "https://acme.mu/home" and a.logo == "https://acme.mu/i.png" and a.n == 9
    assert a.ld.type == "Organization" and a.ld.employees == "12" and a.ld.mails == ["hi@acme.mu"]
    assert (a.place.city, a.place.country, a.place.formatted) == ("Ebene", "Mauritius", "Ebene, Mauritius")
    assert [(s.type, s.url) for s in a.socials] == [("linkedin_company", "https://www.linkedin.com/company/acme-mu"), ("twitter", "https://twitter.com/acme"), ("github", "https://github.com/acme")]
    assert a.listed == ["https://acme.mu/company/one", "https://other.io/"] and a.mails == ["a@acme.mu", "hi@acme.mu"] and a.found == ["a@acme.mu", "b@acme.mu", "hi@acme.mu"]
    assert b.place.formatted == "Germany" and b.socials == [] and c.ld.type is None


def test_people(spark):
    text = "we met. Jane Doe, CEO of it. CTO: John Smith. and Jane Doe - Founder. About Us, Director"
    html = '<a href="https://www.linkedin.com/in/mary-major-12">x</a>'
    got = out(spark, lambda t, h: E.people(t, h, F.lit("Acme")), text, html)
    assert [(p.name, p.title) for p in got] == [("Jane Doe", "Chief Executive Officer"), ("John Smith", "Chief Technology Officer"), ("Mary Major", "Executive / Leadership")]
    p = out(spark, E.search_person, "Jane Doe - CEO - Acme | LinkedIn", "", "https://linkedin.com/in/jane-doe")
    assert (p.name, p.role) == ("Jane Doe", "CEO")
    assert out(spark, E.company_profile, '<a href="https://linkedin.com/company/jobs"><a href="https://www.linkedin.com/company/Acme-X">', "") == "https://www.linkedin.com/company/acme-x"
    rel = lambda t, u: out(spark, lambda a, b: E.relevance(a, F.lit(""), b, F.lit("acme.io"), F.lit("Acme")), t, u)
    assert rel("about acme.io", "https://z.com") == "high" and rel("Jane at Acme!", "https://linkedin.com/in/j") == "medium" and rel("Acmes", "https://linkedin.com/in/j") is None


def test_sectors(spark):
    sectors = {"Retail, Supermarkets & E-Commerce": ["store", "club card"], "Software, SaaS & Cloud Computing": ["software", "api"]}
    f = lambda u, t, x: out(spark, lambda a, b, c: E.classify_sector(a, b, c, sectors), u, t, x)
    r = f("https://a.com/api", "The API", "api api store")
    assert (r.sector, r.sub, r.confidence) == ("Software, SaaS & Cloud Computing", "Corporate", 0.92)
    assert f("https://x.store/", "", "").sector == "Retail, Supermarkets & E-Commerce"
    assert (f("https://u.edu/", "", "").sector, f("https://u.com/", "", "").confidence) == ("Education & EdTech", 0.5)
    typed = out(spark, lambda a: E.classify_sector(a, F.lit(""), F.lit(""), sectors, F.lit("Grocery-Store"), {"grocerystore": "Retail"}), "https://u.com")
    assert (typed.sector, typed.confidence) == ("Retail", 0.95)


def test_chunks_and_maps(spark):
    got = out(spark, lambda c: X.chunks(c, 4), "abcdefghi")
    assert [(c.chunk_index, c.chunk) for c in got] == [(0, "abcd"), (1, "efgh"), (2, "i")]
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": "4"})], "o map<string,string>, n map<string,string>")
    assert df.select(X.merge_maps(F.col("o"), F.col("n")).alias("m")).first().m == {"a": "1", "b": "3", "c": "4"}
    e = spark.createDataFrame([([("k", 1), ("j", 2), ("k", 3)],)], "e array<struct<key:string,value:int>>")
    assert e.select(X.last_by_key(F.col("e")).alias("m")).first().m == {"k": 3, "j": 2}


def test_freshness(spark):
    rows = [("VERIFIED", "2024-01-08 00:00:00", True), ("VERIFIED", "2024-01-01 00:00:00", False), ("PHASE1_VERIFYING", "2024-01-09 00:00:00", False), ("VERIFIED", None, False)]
    df = spark.createDataFrame(rows, "s string, at string, want boolean").withColumn("at", F.col("at").cast("timestamp_ntz"))
    got = df.select(X.fresh(F.col("s"), F.col("at"), F.lit(None).cast("timestamp_ntz"), "2024-01-10 00:00:00").alias("x"), "want").collect()
    assert all(r.x == r.want for r in got)
