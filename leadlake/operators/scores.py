"""Scoring models as Column expressions: sums of weights, capped, with their reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions import text as X
from leadlake.functions import url as U
from leadlake.operators.ladder import let

#: employers' words, executives' words, slugs, weights and thresholds.
EXECUTIVE = ["founder", "ceo", "cto", "coo", "cfo", "chief", "president", "director", "head of", "vp", "executive"]
PROFILE_NOT = ["search", "jobs", "feed", "login", "signup", "home", "pub", "in", "sharing", "posts"]
NAME_NOT = ["the", "and", "inc", "ltd", "corp", "llc", "com", "net", "org", "app", "io"]
REQUIRED = ["company_name", "canonical_domain", "description", "industry_sector", "raw_storage_vault_path", "crawled_page_text", "extracted_word_count"]
RECOMMENDED = {"location_region": 10, "verified_contact_email": 15, "company_size_tier": 10, "company_linkedin_url": 5, "key_people": 30}
BAD_NAMES = ["unknown", "n/a", "none", "null", "example", "test company"]
BAD_DOMAINS = ["unknown", "unknown.com", "example.com", "localhost"]
BAD_DESCRIPTIONS = ["unknown", "n/a", "none", "null", "commercial web", "placeholder", "default", "test data", "intelligence dossier synthesis pending.", "enterprise lead"]
BAD_SECTORS = ["unknown", "commercial web", "other", "n/a", "none"]
COMPLETE_FIELDS = ["company_name", "description", "industry", "headquarters", "founding_year", "employee_count", "technologies", "contact_emails", "key_people", "funding_stage", "products"]


def _sum(*cols: Column) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _if(hit: Column, points) -> Column:
    return F.when(F.coalesce(hit, F.lit(False)), points).otherwise(0)


def _text(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


def _word_in(text: Column, word: Column) -> Column:
    """Whether word stands in text between other characters than word characters; word is data, so it is compared, not compiled."""
    tidy = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " ")), F.lit(" "))
    return (F.trim(tidy(word)) != "") & F.contains(tidy(text), tidy(word))


def person_match(name: Column, role: Column, company: Column, domain: Column, evidence: Column, profile: Column, source: Column, page: Column) -> Column:
    """struct(status, score, signals, reason): how surely a person belongs to a company. Each step names its values once, so that the
    expression does not grow with how often the next one reads them."""
    c, d = F.lower(_text(company)), U.canonical_domain(F.coalesce(domain, F.lit("")))
    slug = F.lower(F.regexp_extract(F.coalesce(X.truthy(profile), source, F.lit("")), r"(?i)https?://(?:[a-z0-9\-]+\.)?linkedin\.com/in/([a-z0-9\-_]{2,})", 1))
    given = F.struct(_text(name).alias("n"), F.lower(role).alias("role"), c.alias("c"), d.alias("d"), _text(evidence).alias("said"), F.coalesce(source, F.lit("")).alias("source"), slug.alias("slug"), F.lower(page).alias("page"))
    return let(given, lambda g: let(_names(g), lambda v: let(_findings(g, v), lambda f: _judged(g, v, f))))


def _names(g: Column) -> Column:
    """What the company is called, what the evidence says, and another employer that it names."""
    c, d = g["c"], g["d"]
    other = F.lower(F.trim(F.regexp_extract(g["said"], r"(?:at|@|founder\s+of|ceo\s+(?:at|of)|coo\s+(?:at|of)|cto\s+(?:at|of))\s+([A-Z][A-Za-z0-9\s&]{2,30})", 1)))
    return F.struct(
        F.when(d != "", F.lower(U.brand(d))).otherwise("").alias("brand"), F.when(F.contains(c, F.lit(".")), F.lower(U.brand(c))).otherwise(c).alias("own"),
        F.substring_index(d, ".", 1).alias("label"), F.lower(F.concat_ws(" ", g["said"], g["source"])).alias("all"), other.alias("other"),
    )


def _findings(g: Column, v: Column) -> Column:
    c, d, all_, other = g["c"], g["d"], v["all"], v["other"]
    has = lambda t, w: (w == "") | F.contains(t, w)  # noqa: E731  an empty name is in everything
    names = [c, v["own"], v["brand"]]
    same = reduce(lambda a, b: a | b, [has(other, w) | F.contains(w, other) for w in names]) | ((v["label"] != "") & F.contains(other, v["label"]))
    absent = reduce(lambda a, b: a & b, [~has(all_, w) for w in names]) & ((d == "") | ~F.contains(all_, d))
    parts = F.filter(F.split(c, r"[\s.\-]+"), lambda w: (F.length(w) >= 3) & ~w.isin(NAME_NOT))
    parts = F.concat(parts, F.filter(F.array(v["label"], v["own"]), lambda w: F.length(w) >= 3))
    where = F.when((d != "") & F.contains(all_, d), "domain").when(F.exists(parts, lambda w: _word_in(all_, w)), "name").when((v["brand"] != "") & _word_in(all_, v["brand"]), "brand").otherwise("")
    return F.struct(
        ((other != "") & ~same).alias("elsewhere"), absent.alias("absent"), where.alias("where"), ((g["slug"] != "") & ~g["slug"].isin(PROFILE_NOT)).alias("linked"),
        F.coalesce((g["n"] != "") & F.contains(g["page"], F.lower(g["n"])), F.lit(False)).alias("on_page"), F.coalesce(g["role"].rlike(U.quoted(EXECUTIVE)), F.lit(False)).alias("exec"),
        (F.contains(F.lower(g["n"]), F.lit("good food")) | all_.rlike("recipe|cooking")).alias("recipe"), ((F.length(g["n"]) < 3) | F.lower(g["n"]).isin(X.GENERIC_TITLES)).alias("bad_name"),
    )


def _judged(g: Column, v: Column, f: Column) -> Column:
    conflict = f["elsewhere"] & ~f["absent"]
    capped, away, unbacked = conflict & ~f["on_page"], f["elsewhere"] & f["absent"], (f["where"] == "") & ~f["on_page"]
    named = F.when(f["where"] == "", 0.0).when(conflict, 0.10).when(f["where"] == "domain", 0.40).otherwise(0.35)
    raw = F.round(F.least(F.lit(1.0), _sum(_if(f["linked"], 0.35), named, _if(f["on_page"], 0.30), _if(f["exec"], 0.15))), 2)

    def by_score(score: Column) -> Column:
        final = F.when(f["bad_name"], 0.0).when(f["recipe"], 0.05).when(away, 0.15).otherwise(score)
        status = F.when(f["bad_name"] | f["recipe"] | away | unbacked, "REJECTED").when(score >= 0.90, "VERIFIED").when(score >= 0.75, "HIGH_CONFIDENCE").when(score >= 0.50, "REVIEW").otherwise("REJECTED")
        return F.struct(status.alias("status"), final.alias("score"))

    signals = F.array_compact(F.array(
        F.when(f["linked"], F.lit("genuine_linkedin_profile")), F.when(f["where"] == "domain", F.concat(F.lit("exact_domain_in_evidence("), g["d"], F.lit(")"))), F.when(f["where"] == "name", F.lit("company_name_in_evidence")),
        F.when(f["where"] == "brand", F.concat(F.lit("brand_in_evidence("), v["brand"], F.lit(")"))), F.when(f["on_page"], F.lit("person_named_on_official_website")), F.when(f["exec"], F.lit("verified_executive_role")),
        F.when(capped, F.concat(F.lit("capped_other_employer("), v["other"], F.lit(")"))),
    ))
    score = let(F.when(capped, F.least(F.lit(0.65), raw)).otherwise(raw), lambda s: F.when(unbacked, F.least(F.lit(0.40), s)).otherwise(s))

    def told(s: Column, signals: Column) -> Column:
        reason = F.when(f["bad_name"], "invalid name").when(f["recipe"], "recipe text").when(away, F.concat(F.lit("works at "), v["other"])).when(unbacked, "no evidence of the company").otherwise(F.array_join(signals, ", "))
        return F.struct(s["status"].alias("status"), s["score"].alias("score"), signals.alias("signals"), reason.alias("reason"))

    return let(F.struct(let(score, by_score).alias("s"), signals.alias("signals")), lambda t: told(t["s"], t["signals"]))


def candidate_match(match: Column, profile: Column, name: Column, role: Column) -> Column:
    """The match behind a gate on the profile's address; leadership by title words."""
    leader = F.lower(role).rlike(U.quoted([*EXECUTIVE, "partner"]))
    ok = U.is_personal_profile(profile)
    return F.struct(F.when(ok, match["status"]).otherwise("REJECTED").alias("status"), F.when(ok, match["score"]).otherwise(0.0).alias("score"), F.coalesce(leader, F.lit(False)).alias("is_leadership"))


def company_match(domain: Column, name: Column, pages: Column, has_person: Column, mails: Column, technologies: Column) -> Column:
    """struct(status, score): whether crawled pages (array of addresses) are of the company."""
    d, n = U.canonical_domain(domain), F.lower(_text(name))
    own = F.size(F.filter(pages, lambda p: F.contains(U.canonical_domain(p), d)))
    ratio = F.when(F.coalesce(F.size(pages), F.lit(0)) > 0, F.round(own / F.size(pages) * 0.25, 2)).otherwise(0.20)
    named = (n != "") & (n != "company") & ~n.isin(X.GENERIC_TITLES)
    score = F.round(F.least(F.lit(1.0), 0.50 + ratio + _if(named, 0.10) + _if(has_person, 0.15) + _if(F.size(mails) > 0, 0.05) + _if(F.size(technologies) > 0, 0.05)), 2)
    generic = (d == "") | n.isin(X.GENERIC_TITLES)
    score = F.when(generic, 0.20).otherwise(score)
    status = F.when(generic, "MISMATCH").when(score >= 0.85, "VERIFIED").when(score >= 0.65, "PARTIAL_MATCH").when(score >= 0.40, "LOW_CONFIDENCE").otherwise("MISMATCH")
    return F.struct(status.alias("status"), score.alias("score"))


def evidence_by_field(evidence: DataFrame, session: str = "session_id") -> DataFrame:
    """Evidence rows (session, field, value, status, updated_at) -> one row for each session with a map from field to its newest evidence."""
    entry = F.struct("value", "status")
    newest = evidence.groupBy(session, "field").agg(F.max_by(entry, F.struct("updated_at", "value", "status")).alias("e"))
    return newest.groupBy(session).agg(F.map_from_entries(F.collect_list(F.struct("field", "e"))).alias("evidence"))


def contract(s: dict[str, Column], evidence: Column, infra_failure: Column, people_verified: Column, vault_word: str) -> Column:
    """struct of the evidence contract: which required and recommended fields are met, completeness, confidence and the final state.

    s: company_name, domain, description, industry, headquarters, email, company_size, linkedin_url of the session; evidence: map field ->
    struct(value, status); vault_word: what a path in the vault holds.
    """
    of = lambda f: F.try_element_at(evidence, F.lit(f))
    value = lambda f, k=None: F.coalesce(X.truthy(of(f)["value"]), X.truthy(s[k]) if k else F.lit(None).cast("string"))
    verified = lambda f: F.coalesce(of(f)["status"] == "VERIFIED", F.lit(False))
    name, domain, text = _text(s["company_name"]), F.replace(F.lower(_text(s["domain"])), F.lit("www."), F.lit("")), _text(s["description"])
    sector = _text(value("industry_sector", "industry"))
    body = _text(of("crawled_page_text")["value"])
    stated = F.regexp_extract(body, r"(?i)(\d+)\s*(?:chars|characters)", 1)
    chars = F.when(stated != "", stated.try_cast("int")).otherwise(F.length(body))
    met = {
        "company_name": (F.length(name) >= 2) & ~F.lower(name).isin(BAD_NAMES),
        "canonical_domain": (F.length(domain) >= 4) & F.contains(domain, F.lit(".")) & ~domain.isin(BAD_DOMAINS),
        "description": (F.length(text) >= 20) & ~F.lower(text).rlike(U.quoted(BAD_DESCRIPTIONS)),
        "industry_sector": (F.length(sector) >= 3) & ~F.lower(sector).isin(BAD_SECTORS) & ~F.coalesce(of("industry_sector")["status"] == "UNVERIFIED", F.lit(False)),
        "raw_storage_vault_path": F.coalesce((F.length(of("raw_storage_vault_path")["value"]) >= 5) & F.contains(of("raw_storage_vault_path")["value"], F.lit(vault_word)), F.lit(False)) & verified("raw_storage_vault_path"),
        "crawled_page_text": F.coalesce(chars >= 100, F.lit(False)) & verified("crawled_page_text"),
        "extracted_word_count": (X.digits(_text(of("extracted_word_count")["value"])) >= 20) & verified("extracted_word_count"),
    }
    none = ["unknown", "n/a", "not specified", "not_found_after_search"]
    said = lambda c: F.coalesce((c != "") & ~F.lower(c).isin(none), F.lit(False))
    good = {
        "location_region": said(value("location_region", "headquarters")),
        "verified_contact_email": said(value("verified_contact_email", "email")) & F.coalesce(F.contains(value("verified_contact_email", "email"), F.lit("@")), F.lit(False)),
        "company_size_tier": said(value("company_size_tier", "company_size")),
        "company_linkedin_url": F.coalesce(F.contains(F.lower(value("company_linkedin_url", "linkedin_url")), F.lit("linkedin.com/company")), F.lit(False)),
        "key_people": F.coalesce(people_verified, F.lit(False)),
    }
    core = _sum(*[met[f].cast("int") for f in REQUIRED])
    earned = _sum(*[_if(good[f], w) for f, w in RECOMMENDED.items()])
    score = F.round(X.clamp(core / len(REQUIRED) * 60.0 + earned / float(sum(RECOMMENDED.values())) * 40.0, 0.0, 100.0), 1)
    broken = F.coalesce(infra_failure, F.lit(False))
    state = F.when(broken, "PHASE1_BLOCKED").when(core == len(REQUIRED), "VERIFIED").when(core >= 3, "PARTIALLY_VERIFIED").otherwise("NEEDS_REVIEW")
    missing = lambda d: F.array_compact(F.array(*[F.when(~hit, F.lit(f)) for f, hit in d.items()]))
    return F.struct(state.alias("state"), core.alias("core_passed"), score.alias("completeness"), F.round(score / 100, 2).alias("confidence"), missing(met).alias("missing_required"), missing(good).alias("missing_recommended"))


def priority(words: Column, artifacts: Column, mails: Column, subpages: Column) -> Column:
    """struct(score, reasons): which card to verify first."""
    n = lambda a: F.coalesce(F.size(a), F.lit(0))
    parts = [
        (words > 1000, 15.0, "High evidence text volume (>1000 words)"), (words.between(301, 1000), 8.0, "Moderate evidence text volume"),
        (n(artifacts) > 0, 15.0, "Raw storage available"), (n(mails) > 0, 15.0, "Verified contact email found on website"),
        (n(subpages) >= 5, 15.0, "Deep multi-page corporate crawl"), (n(subpages).between(1, 4), 8.0, "Subpage coverage"),
    ]
    score = X.clamp(F.round(F.lit(40.0) + _sum(*[_if(h, p) for h, p, _ in parts]), 1), 10.0, 100.0)
    return F.struct(score.alias("score"), F.array_compact(F.array(*[F.when(F.coalesce(h, F.lit(False)), F.lit(r)) for h, _, r in parts])).alias("reasons"))


def quality(name: Column, domain: Column, industry: Column, overview: Column, products: Column, hq: Column, size: Column, people: Column, mails: Column, placeholder: str | None = None) -> Column:
    """0 to 100 by how much of a company is known. products and people are arrays of names, mails of addresses; placeholder is a pattern of
    overviews that the engine itself wrote."""
    low = lambda c: F.lower(_text(c))
    known = lambda c, *bad: (low(c) != "") & ~low(c).isin(*bad)
    dotted = F.contains(F.coalesce(domain, F.lit("")), F.lit("."))
    identity = _if(known(name, "unknown", "home", "index") & dotted, F.when(F.contains(low(name), low(domain)), 10).otherwise(15))
    text = known(overview, "unknown", "not specified")
    text = text & ~low(overview).rlike(placeholder) if placeholder else text
    length = F.length(F.trim(overview))
    prods = F.size(F.filter(products, lambda p: ~F.lower(p).isin("unknown", "none", "web infrastructure", "cloud hosting")))
    staff = F.size(F.filter(people, lambda p: (p != "") & ~F.lower(p).isin("unknown", "none", "executive", "leadership")))
    real = F.size(F.filter(mails, lambda e: F.contains(e, F.lit("@")) & ~F.lower(e).rlike(r"example\.com|domain\.com|wixpress")))
    total = _sum(
        identity, _if(known(industry, "unknown", "not specified", "commercial web", "commercial web & digital enterprise"), 15), _if(text & (length >= 40), 15), _if(text & length.between(15, 39), 8),
        _if(prods >= 2, 15), _if(prods == 1, 8), _if(known(hq, "unknown", "not specified", "global", "global hq"), 10), _if(known(size, "unknown", "not specified"), 10), _if(staff >= 2, 10), _if(staff == 1, 6), _if(real > 0, 10),
    )
    return X.clamp(total, 0, 100)


def warmth(score: Column) -> Column:
    return F.round(F.least(F.lit(10.0), score / 10), 1)


def completeness(data: Column) -> Column:
    """Share of the important fields that a map of texts fills."""
    return _sum(*[_if(_text(F.try_element_at(data, F.lit(f))) != "", 1) for f in COMPLETE_FIELDS]) / len(COMPLETE_FIELDS)


def worker_confidence(base: Column, name: Column, url: Column, description: Column, country: Column, complete: Column) -> Column:
    """struct(confidence, verified)."""
    c = F.coalesce(base, F.lit(0.5)) + _if(F.length(name) > 3, 0.10) + _if(_text(url) != "", 0.10) + _if(F.length(description) > 50, 0.10) + _if(_text(country) != "", 0.05) + F.coalesce(complete, F.lit(0.0)) * 0.15
    c = F.round(F.least(F.lit(1.0), c), 4)
    return F.struct(c.alias("confidence"), (c >= 0.60).alias("verified"))


def document_tier(session_tier: Column, meta_tier: Column, text: Column, url: Column) -> Column:
    """Size tier of a document's company: by session, by metadata, by words, else a stable share by the first 32 bits of the address's md5."""
    names = ["Enterprise Leaders (1,000+)", "Mid-Market Challengers (100-1,000)", "Growth SMBs (20-100)", "Early-Stage Startups (1-20)"]
    stated = lambda c: F.when(c.rlike("1000|enterprise"), names[0]).when(c.rlike("mid|100|challenger"), names[1]).when(c.rlike("growth|smb|20"), names[2]).when(c.rlike("early|startup|seed|1-20|1-10"), names[3])
    low = F.lower(F.coalesce(text, F.lit("")))
    told = F.when(low.rlike("enterprise|global leader|fortune 500|multinational"), names[0]).when(low.rlike("mid-market|midmarket|established|challenger"), names[1]).when(low.rlike("growth|smb|series b|series a|scaling"), names[2])
    b = F.conv(F.substring(F.md5(url.cast("binary")), 1, 8), 16, 10).cast("long") % 100
    share = F.when(b < 60, names[3]).when(b < 85, names[2]).when(b < 95, names[1]).otherwise(names[0])
    return F.coalesce(stated(F.lower(session_tier)), stated(F.lower(meta_tier)), told, share)


def company_tier(size_text: Column, count: Column) -> Column:
    from leadlake.functions.facts import standard_tier

    stated = F.when(_text(size_text) != "", standard_tier(size_text))
    counted = F.when(count >= 1000, "Enterprise Leaders (1,000+)").when(count >= 100, "Mid-Market Challengers (100-1,000)").when(count >= 20, "Growth SMBs (20-100)").otherwise("Early-Stage Startups (1-20)")
    return F.coalesce(F.when(stated != "Unknown", stated), counted)


def phase_gate(phase: Column) -> Column:
    """Core fields of a map field -> struct(value, status) that are not verified."""
    core = ["industry_sector", "location_region", "company_size_tier", "verified_contact_email"]
    return F.filter(F.array(*map(F.lit, core)), lambda f: ~F.coalesce(F.try_element_at(phase, f)["status"] == "VERIFIED", F.lit(False)))


def batch_quality(activity: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Activity rows (batch, url, stage, status, message) -> shares and a verdict for each batch, in one aggregation."""
    m = F.coalesce("message", F.lit(""))
    sized = m.rlike("Qualified|Size:")
    small, big = m.rlike("1-200|1-10|11-50|51-200|1-"), m.rlike(">200|Exceeds 200")
    a = activity.groupBy(batch).agg(
        F.count_if((F.col("stage") == "CRAWL") & (F.col("status") == "QUEUED")).alias("relevant"), F.count_if(F.col("stage") == "FILTER").alias("filtered"), F.count_if(F.col("status") == "DUPLICATE").alias("duplicates"),
        F.count_if(sized & small).alias("small"), F.count_if(sized & ~small & big).alias("large"), F.count_if(sized & ~small & ~big).alias("unknown"), F.count_if(~sized & m.rlike("LISTING|(?i:directory)")).alias("directories"),
        F.countDistinct(F.when((F.col("stage") == "CRAWL") & (F.col("status") == "QUEUED"), F.col("url"))).alias("websites"),
    )
    total = F.greatest(F.lit(1), F.col("relevant") + F.col("filtered"))
    for c, name in (("relevant", "pct_relevant"), ("small", "pct_small"), ("unknown", "pct_unknown"), ("large", "pct_large")):
        a = a.withColumn(name, X.percent(F.col(c), total))
    verdict = (
        F.when((F.col("pct_large") >= 20) | ((F.col("pct_relevant") < 50) & (F.col("pct_small") < 30)), "POOR").when(F.col("directories") > 15, "ACCEPTABLE")
        .when((F.col("pct_relevant") >= 65) | (F.col("pct_small") + F.col("pct_unknown") >= 70), "GOOD").otherwise("ACCEPTABLE")
    )
    return a.withColumn("quality", verdict)


def keyword_performance(searches: DataFrame) -> DataFrame:
    """Searches (keyword, executed_at, sources_found, quality, people) -> uses, rate (a moving average, rounded at each step) and deprecation.

    The fold is over one keyword's own uses; a keyword used without bound folds in time order in one row, so split histories upstream."""
    gain = F.when((F.col("quality") == "GOOD") & (F.col("people") > 0), 1.2).otherwise(0.8)
    s = searches.withColumn("gain", F.least(F.lit(1.0), F.coalesce("sources_found", F.lit(0)) / 15.0 * gain))
    g = s.groupBy("keyword").agg(F.array_sort(F.collect_list(F.struct("executed_at", "gain", F.coalesce("sources_found", F.lit(0)).alias("sources"), "quality"))).alias("h"))
    rate = F.aggregate("h", F.lit(0.5), lambda a, x: F.round(a * 0.7 + x["gain"] * 0.3, 4))
    dead = F.exists(F.transform("h", lambda x, i: ((x["sources"] == 0) & (i >= 2)) | ((x["quality"] == "POOR") & (i >= 1))), lambda x: x)
    return g.select("keyword", F.size("h").alias("usage_count"), rate.alias("success_rate"), dead.alias("is_deprecated"))
