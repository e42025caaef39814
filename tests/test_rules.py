"""Ladders: a row for each rule and one that passes. Scores against sums by hand."""

import pytest
from pyspark.sql import functions as F

from leadlake.operators import filters as R
from leadlake.operators import scores as S


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


URLS = [
    ("ftp://x.com", "FORMAT"), ("http://x.com/" + "a" * 500, "LENGTH"), ("http://10.0.0.1/", "PRIVATE"), ("https://x.edu/", "EDU_GOV"), ("https://x.gov.uk/", "EDU_GOV"), ("https://x.news/", "MEDIA_TLD"),
    ("https://daily-x.com/", "MEDIA_HOST"), ("https://porn-x.com", "CATEGORY"), ("https://bad.com/", "BLACKLISTED"), ("https://sub.bad.com/", "BLACKLISTED"), ("https://mymagazin.de/", "GUIDE"), ("https://docs.x.com/", "SERVICE_HOST"),
    ("https://x.com/blog/a", "PATH"), ("https://x.com/a.pdf", "PATH"), ("http://intranet/", "NO_TLD"), ("https://www.acme.com/about", "OK"), ("https://notbad.com/", "OK"),
]


@pytest.mark.parametrize(("url", "rule"), URLS)
def test_url_rules(spark, url, rule):
    v = one(spark, R.filter_url(F.lit(url), blacklisted=["bad.com"]))
    assert (v.rule_id, v.keep) == (rule, rule == "OK")


def test_content_rules(spark):
    ok = "word " * 20
    rows = [("a b", "Title", 2, "THIN"), (ok, " x", 20, "NO_TITLE"), (ok, None, 20, "NO_TITLE"), (ok + "This domain is FOR sale", "Title", 25, "SPAM"), (ok + "attention required! | cloudflare", "Title", 25, "CHALLENGE"), (ok, "404 page", 20, "ERROR_TITLE"), (ok, "Acme", 20, "OK")]
    df = spark.createDataFrame(rows, "t string, h string, n int, want string")
    assert all(r.v.rule_id == r.want for r in df.select(R.filter_content(F.col("t"), F.col("h"), F.col("n")).alias("v"), "want").collect())


def test_entity_rules(spark):
    u = "https://acme.com"
    rows = [
        (None, u, 0.9, "MISSING"), ("ab", u, 0.9, "SHORT"), ("1234", u, 0.9, "NO_LETTER"), ("67A9F99B5716", u, 0.9, "HEX"), ("What now?", u, 0.9, "QUESTION"), ("10 Best CRM", u, 0.9, "LISTICLE"), ("Login to Acme", u, 0.9, "ARTICLE"),
        ("one two three four five six seven", u, 0.9, "SENTENCE"), ("Breaking News", u, 0.9, "NEWS"), ("How to code", u, 0.9, "GUIDE"), ("untitled", u, 0.9, "JUNK"), ("Acme", u, 0.1, "CONFIDENCE"), ("Acme", "", 0.9, "NO_URL"),
        ("Acme", "acme.com", 0.9, "SCHEME"), ("Acme", "https://undefined/", 0.9, "JUNK_URL"), ("Acme", u, 0.9, "OK"),
    ]
    df = spark.createDataFrame(rows, "n string, u string, c double, want string")
    got = df.select("n", R.filter_entity(F.col("n"), F.col("u"), F.col("c")).alias("v"), "want").collect()
    assert [(r.n, r.v.rule_id) for r in got] == [(r.n, r.want) for r in got]


def test_candidates(spark):
    rows = [
        ("Acme", "help desk", "https://support.acme.com", "SUBDOMAIN_RESOURCE", "UNKNOWN", "REJECTED"), ("Acme", "", "https://acme.edu", "INVALID_URL", "UNKNOWN", "REJECTED"), ("Live scores", "", "https://acme.com", "SPORTS_MEDIA", "UNKNOWN", "REJECTED"),
        ("Ministry of X", "", "https://acme.com", "GOVERNMENT_AGENCY", "UNKNOWN", "REJECTED"), ("Acme", "breaking news", "https://acme.com", "MEDIA_EDITORIAL", "UNKNOWN", "REJECTED"), ("Acme", "a restaurant chain", "https://acme.com", "FRANCHISE_CHAIN", ">200", "DEPRIORITIZED"),
        ("Acme", "Fortune 500", "https://acme.com", "LARGE_ENTERPRISE", ">200", "DEPRIORITIZED"), ("Acme", "201-500 employees", "https://acme.com", "LARGE_ENTERPRISE", "201-500", "DEPRIORITIZED"), ("Acme", "11-50 employees", "https://acme.com", "COMPANY", "11-50", "HIGH"),
        ("Acme", "100-300 staff", "https://acme.com", "COMPANY", "100-300", "NORMAL"), ("Acme", "12 people", "https://acme.com", "COMPANY", "1-12", "HIGH"), ("Acme", "900 staff", "https://acme.com", "LARGE_ENTERPRISE", ">200", "DEPRIORITIZED"),
        ("Acme", "a startup", "https://acme.com", "COMPANY", "UNKNOWN (Startup Indicator)", "HIGH"), ("Acme", "tools", "https://acme.com", "COMPANY", "UNKNOWN", "NORMAL"),
    ]
    df = spark.createDataFrame(rows, "t string, s string, u string, kind string, size string, p string")
    for r in df.select("s", R.qualify(F.col("t"), F.col("s"), F.col("u")).alias("v"), "kind", "size", "p").collect():
        assert (r.s, r.v.candidate_type, r.v.company_size, r.v.priority) == (r.s, r.kind, r.size, r.p)


def test_pages(spark):
    links = "".join(f'<a href="https://o{i}.com">x</a>' for i in range(25))
    f = lambda u, h, t: one(spark, R.classify_page(F.lit(u), F.lit(h), F.lit(t)))
    assert tuple(f("https://clutch.co/agencies/x", "", "")) == ("listing", 0.95)
    assert tuple(f("https://linkedin.com/company/acme", "", "")) == ("entity", 0.9)
    v = f("https://a.com", f"<title>Top companies</title>{links}", "directory compare view all")
    assert v.kind == "listing" and v.confidence == 0.95
    assert f("https://a.com", "<title>Acme</title>", "our mission about us contact us").kind == "entity"
    assert tuple(f("https://a.com", "", "")) == ("entity", 0.5)


def test_other_rules(spark):
    cat = lambda t: one(spark, R.disallowed_category(F.lit(t)))
    assert (cat("Adult casino"), cat("poker"), cat("fine")) == ("adult", "gambling", None)
    fact = lambda v, e, d="": one(spark, R.valid_fact(F.lit(v), F.lit(e), F.lit(d)))
    assert fact("Berlin", "in Berlin now") and fact("Berlin Mitte", "Mitte of old Berlin") and not fact("Paris", "in Berlin") and not fact("acme", "acme", "acme.com") and not fact("unknown", "unknown") and not fact("x", None)
    assert [one(spark, R.http_route(F.lit(s))) for s in (200, 403, 429, 500)] == ["CRAWLED_PENDING_AGENT_2", "BLOCKED_NEEDS_ALTERNATIVE_EVIDENCE", "BLOCKED_NEEDS_ALTERNATIVE_EVIDENCE", "FILTERED"]
    assert one(spark, R.media_or_blog(F.lit("X"), F.lit("a lifestyle blog"))) and not one(spark, R.media_or_blog(F.lit("X"), F.lit("tools")))
    route = lambda t, s=None: one(spark, R.moderation_route(R.moderate(F.lit(t), None if s is None else F.lit(s))))
    assert (route("casino"), route("fine"), route("fine", 0.5), route("fine", 0.9)) == ("QUARANTINE_AND_BLOCK", "PASS", "REVIEW_QUEUE", "QUARANTINE_AND_BLOCK")
    assert one(spark, R.headquarters_or_null(F.lit("New York"))) == "New York" and one(spark, R.headquarters_or_null(F.lit("ab12cd34ef56aa"))) is None


def test_not_found(spark):
    kind = "infra_failure string, sources_checked array<string>, search_attempts int, strategies_exhausted boolean, evidence_found boolean"
    rows = [
        ("company_size_tier", ("down", ["a"], 1, True, False), "INFRA"), ("zzz", (None, ["a"], 1, True, False), "UNKNOWN_FIELD"), ("company_size_tier", (None, ["a"], 1, True, False), "SOURCES"),
        ("company_size_tier", (None, ["about_or_company", "x", "search_size"], 1, True, False), "KINDS"), ("company_size_tier", (None, ["about_or_company", "careers_or_team", "search_size"], 0, True, False), "SEARCHES"),
        ("company_size_tier", (None, ["about_or_company", "careers_or_team", "search_size"], 1, False, False), "OPEN"), ("company_size_tier", (None, ["about_or_company", "careers_or_team", "search_size"], 1, True, True), "FOUND"),
        ("company_size_tier", (None, ["about_or_company", "careers_or_team", "search_size"], 1, True, False), "OK"), ("company_size_tier", None, "NO_RECORD"),
    ]
    df = spark.createDataFrame(rows, f"f string, i struct<{kind.replace(' string', ':string').replace(' array', ':array').replace(' int', ':int').replace(' boolean', ':boolean')}>, want string")
    assert all(r.v.rule_id == r.want for r in df.select(R.can_mark_not_found(F.col("f"), F.col("i")).alias("v"), "want").collect())


def test_blocklist_and_robots(spark):
    df = spark.createDataFrame([("https://a.bad.com/x",), ("https://good.com/private/x",), ("https://bad.com",), ("https://bad.com",)], "url string")
    got = R.blocklist(df, "url", spark.createDataFrame([("bad.com",)], "domain string")).collect()
    assert len(got) == 4 and sum(r.is_blocked for r in got) == 3
    ok = R.robots(df, "url", spark.createDataFrame([("good.com", "/private")], "host string, disallow string")).collect()
    assert sum(r.allowed for r in ok) == 3


def test_person_match(spark):
    def f(name, role, evidence, profile=None, page="", company="Acme", domain="acme.io"):
        return one(spark, S.person_match(F.lit(name), F.lit(role), F.lit(company), F.lit(domain), F.lit(evidence), F.lit(profile).cast("string"), F.lit(None).cast("string"), F.lit(page)))

    li = "https://www.linkedin.com/in/jane-doe"
    assert (f("Jane Doe", "CEO", "Jane Doe acme.io", li).status, f("Jane Doe", "CEO", "Jane Doe acme.io", li).score) == ("VERIFIED", 0.9)
    assert f("Jane Doe", "", "acme.io", li).status == "HIGH_CONFIDENCE"
    assert f("Jo", "CEO", "acme.io", li).score == 0.0 and f("Jane Doe", "CEO", "a recipe acme.io").score == 0.05
    assert f("Jane Doe", "CEO", "works at Lumo", li).score == 0.15
    assert f("Jane Doe", "CEO", "CEO at Lumo. Acme partner", li).score == 0.6
    assert (f("Jane Doe", "CEO", "nothing", li).status, f("Jane Doe", "CEO", "nothing", li).score) == ("REJECTED", 0.4)
    assert f("Jane Doe", "CEO", "nothing", li, "our Jane Doe").score == 0.8


def test_contract(spark):
    ev = lambda **k: F.create_map(*[x for f, (v, s) in k.items() for x in (F.lit(f), F.struct(F.lit(v).alias("value"), F.lit(s).alias("status")))])
    base = {"company_name": "Acme", "domain": "www.acme.io", "description": "We build useful tools for people", "industry": "Software", "headquarters": None, "email": None, "company_size": None, "linkedin_url": None}
    s = {k: F.lit(v).cast("string") for k, v in base.items()}
    full = ev(raw_storage_vault_path=("vault/x/y", "VERIFIED"), crawled_page_text=("1200 chars", "VERIFIED"), extracted_word_count=("220 words", "VERIFIED"), location_region=("Berlin", "VERIFIED"))
    v = one(spark, S.contract(s, full, F.lit(False), F.lit(True), "vault"))
    assert (v.state, v.core_passed, v.completeness) == ("VERIFIED", 7, round(60 + 40 / 70 * 40, 1)) and v.missing_recommended == ["verified_contact_email", "company_size_tier", "company_linkedin_url"]
    part = one(spark, S.contract(s, ev(x=("y", "z")), F.lit(False), F.lit(False), "vault"))
    assert (part.state, part.core_passed) == ("PARTIALLY_VERIFIED", 4)
    assert one(spark, S.contract(s, full, F.lit(True), F.lit(True), "vault")).state == "PHASE1_BLOCKED"
    assert one(spark, S.contract({k: F.lit(None).cast("string") for k in base}, ev(x=("y", "z")), F.lit(False), F.lit(False), "vault")).state == "NEEDS_REVIEW"


def test_scores(spark):
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    p = one(spark, S.priority(F.lit(1200), arr("a"), arr("m"), arr(*"abcde")))
    assert p.score == 100.0 and len(p.reasons) == 4
    assert one(spark, S.priority(F.lit(None).cast("int"), arr(), arr(), arr())).score == 40.0
    q = lambda *a: one(spark, S.quality(*a))
    t = F.lit
    assert q(t("Acme"), t("tools.io"), t("Software"), t("x" * 45), arr("a", "b"), t("Berlin"), t("11-50"), arr("J D", "K L"), arr("a@x.io")) == 100
    assert q(t("Acme"), t("acme.io"), t("unknown"), t("x" * 20), arr("a"), t("Global"), t(""), arr("J D"), arr("a@example.com")) == 15 + 8 + 8 + 6
    m = one(spark, S.company_match(t("acme.io"), t("Acme"), arr("https://acme.io/a", "https://b.io"), t(True), arr("x"), arr()))
    assert (m.status, m.score) == ("VERIFIED", 0.93)
    w = one(spark, S.worker_confidence(t(0.5), t("Acme"), t("u"), t("d" * 60), t("DE"), t(1.0)))
    assert (w.confidence, w.verified) == (1.0, True)
    assert one(spark, S.completeness(F.create_map(t("industry"), t("x"), t("products"), t("")))) == pytest.approx(1 / 11)
    assert one(spark, S.document_tier(t(None).cast("string"), t("startup"), t(""), t("u"))) == "Early-Stage Startups (1-20)"
    assert one(spark, S.company_tier(t("50-200"), t(5))) == "Growth SMB (51-200)"
