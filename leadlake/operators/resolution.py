"""Unified resolution of a company's record from several signals, and what to look at next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions import facts as E
from leadlake.functions import text as X
from leadlake.functions import url as U
from leadlake.operators import scores as S

#: Sectors named by words, in order; words of at most three letters must stand alone.
SECTOR_WORDS = {
    "Retail, Supermarkets & E-Commerce": ["supermarket", "grocery", "groceries", "hypermarket", "retail", "store", "ecommerce", "cart"],
    "Food, Beverage & Hospitality": ["restaurant", "hotel", "resort", "dining", "hospitality", "food", "cafe"],
    "Artificial Intelligence & ML": ["ai", "artificial intelligence", "llm", "gpt", "neural", "deep learning"],
    "Developer Tools & Software": ["dev", "api", "code", "github", "developer", "sdk", "library"],
    "Cloud Infrastructure & DevOps": ["cloud", "aws", "server", "docker", "kubernetes", "infrastructure", "devops"],
    "Cybersecurity & Privacy": ["security", "auth", "cyber", "firewall", "privacy", "vault", "encrypt"],
    "Fintech & Financial Services": ["bank", "finance", "crypto", "billing", "fintech", "wealth", "tax"],
    "Healthcare & Life Sciences": ["health", "medical", "clinical", "pharma", "biotech", "healthcare"],
    "Logistics, Transport & Supply Chain": ["logistics", "shipping", "freight", "cargo", "warehouse", "delivery", "trucking"],
    "Real Estate, Architecture & Construction": ["property", "real estate", "construction", "architecture", "building"],
    "Manufacturing, Industrial & Hardware": ["manufacturing", "industrial", "factory", "machinery", "automotive"],
    "Data Analytics & BI": ["analytics", "pipeline", "etl", "big data", "business intelligence"],
    "Marketing Tech & CRM": ["marketing", "campaign", "crm", "lead gen"],
    "EdTech & Education": ["academy", "course", "school", "university", "edtech"],
    "Digital Media & Gaming": ["streaming", "video", "audio", "music", "gaming"],
}
#: Cities named in texts, in order.
CITIES = {
    "seattle": "Seattle, WA, USA", "new york": "New York, NY, USA", "austin": "Austin, TX, USA", "boston": "Boston, MA, USA", "chicago": "Chicago, IL, USA",
    "los angeles": "Los Angeles, CA, USA", "san francisco": "San Francisco, CA, USA", "palo alto": "Palo Alto, CA, USA",
    "silicon valley": "Santa Clara, CA, USA", "denver": "Denver, CO, USA", "atlanta": "Atlanta, GA, USA", "london": "London, United Kingdom",
    "paris": "Paris, France", "berlin": "Berlin, Germany", "toronto": "Toronto, ON, Canada", "tokyo": "Tokyo, Japan",
    "bengaluru": "Bengaluru, KA, India", "singapore": "Singapore", "port louis": "Port Louis, Mauritius",
}
#: Pages to look at for a missing field, in order.
RECRAWL = {
    "location_region": ["/contact", "/locations", "/about"], "company_size_tier": ["/careers", "/team", "/about"],
    "verified_contact_email": ["/contact", "/support"], "industry_sector": ["/about", "/company", "/products", "/solutions"],
}


def words_hit(text: Column, words: list[str]) -> Column:
    short = [w for w in words if len(w) <= 3]
    long = [w for w in words if len(w) > 3]
    parts = ([rf"(?<![a-z0-9_])(?:{U.quoted(short)})(?![a-z0-9_])"] if short else []) + ([U.quoted(long)] if long else [])
    return text.rlike("|".join(parts))


def inferred_sector(classified: Column, text: Column) -> Column:
    """The classifier's sector if it is sure, else the first sector with a word in the text."""
    low = F.lower(text)
    told = F.coalesce(*[F.when(words_hit(low, words), F.lit(name)) for name, words in SECTOR_WORDS.items()], F.lit("Unknown"))
    return F.when(classified["confidence"] >= 0.60, classified["sector"]).otherwise(told)


def inferred_location(url: Column, text: Column) -> Column:
    low = F.lower(F.concat_ws(" ", url, text))
    named = F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(place)) for w, place in CITIES.items()])
    return F.coalesce(E.headquarters(text), U.country(url), named, F.lit("Unknown"))


def resolve_record(data: Column, place: Column, text: Column, schema_employees: Column, mails: Column, domain_name: Column) -> Column:
    """struct(headquarters, country, company_size, company_tier, industry, contact_emails). data: map of extracted texts; place:
    struct(formatted, country) of the page; later signals fill what earlier ones lack."""
    of = lambda k: X.truthy(F.try_element_at(data, F.lit(k)))
    stated = F.coalesce(of("company_size"), of("employee_count"), X.truthy(schema_employees))
    stated = F.when(F.upper(stated) != "UNKNOWN", stated)
    told = E.size_from_prose(F.coalesce(text, F.lit("")))
    size = F.coalesce(stated, F.when(told["size"] != "Unknown", told["size"]), F.lit("Unknown"))
    tier = F.when(stated.isNotNull(), E.standard_tier(stated)).otherwise(told["tier"])
    vague = F.array(F.lit("unknown"), F.lit("general"), F.lit("none"), F.concat(F.lower(domain_name), F.lit(" industry")))
    industry = F.when(of("industry").isNotNull() & ~F.array_contains(vague, F.lower(of("industry"))), of("industry")).otherwise(domain_name)
    own = F.filter(F.split(F.coalesce(of("contact_emails"), of("emails"), F.lit("")), r"\s*,\s*"), lambda e: e != "")
    return F.struct(
        F.coalesce(of("headquarters"), of("location"), place["formatted"]).alias("headquarters"), F.coalesce(place["country"], X.normalize_country(of("country")), F.lit("United States")).alias("country"),
        size.alias("company_size"), tier.alias("company_tier"), industry.alias("industry"), X.ordered_union(own, mails).alias("contact_emails"),
    )


def recrawl_paths(missing: Column, crawled: Column, limit: int = 3) -> Column:
    """Pages to crawl next for the missing fields, without those crawled."""
    wanted = F.flatten(F.array(*[F.when(F.array_contains(missing, f), F.array(*map(F.lit, ps))).otherwise(F.array().cast("array<string>")) for f, ps in RECRAWL.items()]))
    return X.remaining(F.array_distinct(wanted), crawled, limit, F.array(F.lit("/about"), F.lit("/contact")))


def assemble(sessions: DataFrame, documents: DataFrame, evidence: DataFrame, people: DataFrame) -> DataFrame:
    """Sessions with the map of their evidence, missing text, words and path filled from the document (six characters a word), and whether a
    verified person is known: what scores.contract asks for. Equi-joins on one row for each session."""
    ev = S.evidence_by_field(evidence)
    ok = people.groupBy("session_id").agg(F.bool_or(F.col("verification_status").isin("VERIFIED", "HIGH_CONFIDENCE")).alias("people_verified"))
    d = documents.select(F.col("id").alias("document_id"), "word_count", "raw_path")
    j = sessions.join(d, "document_id", "left").join(ev, F.col("id") == ev.session_id, "left").drop("session_id").join(ok, F.col("id") == ok.session_id, "left").drop("session_id")
    entry = lambda v: F.struct(v.cast("string").alias("value"), F.lit("VERIFIED").alias("status"))
    some = F.col("word_count") > 0
    spare = F.map_filter(F.create_map(
        F.lit("raw_storage_vault_path"), F.when(F.col("raw_path").isNotNull(), entry(F.col("raw_path"))), F.lit("crawled_page_text"), F.when(some, entry(F.concat((F.col("word_count") * 6).cast("string"), F.lit(" chars")))),
        F.lit("extracted_word_count"), F.when(some, entry(F.col("word_count"))),
    ), lambda k, v: v.isNotNull())
    none = F.expr("cast(map() as map<string,struct<value:string,status:string>>)")
    return j.withColumn("evidence", X.merge_maps(spare, F.coalesce("evidence", none))).withColumn("people_verified", F.coalesce("people_verified", F.lit(False))).drop("word_count", "raw_path")


def evaluate(assembled: DataFrame, vault_word: str) -> DataFrame:
    """The contract over assembled sessions."""
    s = {c: (F.col(c) if c in assembled.columns else F.lit(None).cast("string")) for c in ("company_name", "domain", "description", "industry", "headquarters", "email", "company_size", "linkedin_url")}
    infra = F.col("infra_failure") if "infra_failure" in assembled.columns else F.lit(False)
    return assembled.withColumn("contract", S.contract(s, F.col("evidence"), infra, F.col("people_verified"), vault_word))


#: Search templates by round, for profiles of a company's people.
PROFILE_QUERIES = {
    1: ["{brand} CEO linkedin profile", "{brand} founder CEO linkedin", "{domain} CEO founder linkedin profile", "{brand} co-founder linkedin", "{domain} leadership team linkedin", 'site:linkedin.com/in/ "{brand}" CEO', 'site:linkedin.com/in/ "{brand}" founder'],
    2: ["{brand} CTO founder linkedin", "{brand} executive team linkedin profile", "{domain} co-founder linkedin profile", "{brand} VP Head linkedin", "who is the CEO of {brand}", "who founded {brand} {domain}", 'site:linkedin.com/in/ "{brand}" "Co-Founder"', 'site:linkedin.com/in/ "{brand}" "Head of"'],
}


def profile_queries(companies: DataFrame, search_round: int) -> DataFrame:
    """companies (name, domain) times the round's templates; legal forms are left out of the brand."""
    legal = r"(?i)\b(inc|llc|ltd|gmbh|corp|corporation|technologies|solutions|group|holdings|pte)\b"
    name = F.coalesce(X.truthy(F.col("name")), U.brand(F.col("domain")))
    brand = F.coalesce(X.truthy(F.trim(F.regexp_replace(name, legal, ""), F.lit(" ,.-"))), name)
    ts = F.array(*map(F.lit, PROFILE_QUERIES[search_round]))
    d = F.replace(F.lower("domain"), F.lit("www."), F.lit(""))
    return companies.select("name", "domain", F.posexplode(ts).alias("place", "t"), brand.alias("_b")).select("name", "domain", "place", F.replace(F.replace(F.col("t"), F.lit("{brand}"), F.col("_b")), F.lit("{domain}"), d).alias("query"))
