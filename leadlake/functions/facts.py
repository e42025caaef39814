"""Facts from prose: head counts, places, people, titles, sectors, contacts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlake.functions import text as X
from leadlake.functions import url as U

TIERS = [(10, "Startup / Micro (1-10)"), (50, "Small (11-50)"), (200, "Growth SMB (51-200)"), (999, "Mid-Market (201-1000)")]
TOP_TIER = "Enterprise (1000+)"
BUCKETS = [(10, "1-10"), (50, "11-50"), (200, "51-200"), (500, "201-500"), (1000, "501-1000"), (5000, "1001-5000")]
#: Technologies looked for as words inside text, with their names, in order.
TECH = {
    "react": "React.js", "next": "Next.js", "vue": "Vue.js", "angular": "Angular", "tailwind": "Tailwind CSS", "node": "Node.js",
    "python": "Python", "fastapi": "FastAPI", "django": "Django", "flask": "Flask", "postgres": "PostgreSQL", "redis": "Redis",
    "docker": "Docker", "kubernetes": "Kubernetes", "aws": "AWS", "cloudflare": "Cloudflare CDN", "graphql": "GraphQL", "go": "Golang",
    "rust": "Rust", "java": "Java Spring Boot", "stripe": "Stripe API", "searxng": "SearXNG Engine",
}
#: Titles of executives.
TITLE = r"(?:CEO|CTO|COO|CFO|President|Founder|Co-Founder|Managing Director|Executive Director|Vice President|VP|Director|Head of [A-Za-z]+|Chief [A-Za-z]+ Officer)"
#: Words that no name of a person holds.
NOT_NAMES = [
    "about", "contact", "home", "privacy", "terms", "policy", "company", "careers", "login", "sign", "register", "services", "products",
    "solutions", "features", "support", "sales", "news", "blog", "press", "media", "overview", "global", "world", "bank", "open", "data",
    "github", "desktop", "qatar", "airways", "what", "is", "how", "why", "story", "stories", "success", "founders", "founder",
    "leadership", "business", "model", "forbes", "aws", "cloud", "software", "platform", "official", "portal", "website", "inc", "corp",
    "llc", "university", "academy", "college", "school", "developer", "developers", "dev", "app", "apps", "application", "applications",
    "apk", "help", "guide", "download", "downloads", "introducing", "introduction", "free", "shipping", "price", "buy", "online", "shop",
    "store", "product", "project", "projects", "video", "videos", "channel", "awards", "award", "design", "designs", "results", "records",
    "search", "case", "court", "federal", "pacer", "unicourt", "lotto", "api", "apis", "web", "tutorial", "tutorials", "course",
    "courses", "forum", "community", "tv", "youtube", "google", "android", "ios", "apple", "microsoft", "windows", "linux", "mac", "log",
    "in", "up", "out", "cart", "checkout", "long", "before", "after", "while", "during", "best", "top", "profitable", "ideas", "ways",
    "tools", "near", "me", "our", "team", "people", "management", "executive", "board", "investors", "partners", "advisor", "advisors",
    "consultant", "group", "holdings", "ltd", "ceo", "cto", "cfo", "coo", "chief", "president", "director", "manager", "officer", "vice",
    "vp", "lead", "head", "and", "or", "of", "the", "co-founder", "cofounder",
]
BLOCKED_NAMES = [
    "good food", "best food", "home page", "about us", "contact us", "privacy policy", "terms service", "terms of", "read more", "sign up",
    "sign in", "best saas", "top saas", "choiseul 100", "forbes 30", "tedx speaker", "times top",
]

_N = r"(\d{1,3}(?:,\d{3})+|\d{1,6})"


def _steps(n: Column, steps: list[tuple[int, str]], last: str) -> Column:
    out = F.lit(last)
    for top, name in reversed(steps):
        out = F.when(n <= top, name).otherwise(out)
    return F.when(n.isNotNull(), out)


def size_tier(n: Column) -> Column:
    return _steps(n, TIERS, TOP_TIER)


def size_bucket(n: Column) -> Column:
    return _steps(n, BUCKETS, "5000+")


def _num(c: Column, rx: str, group: int = 1) -> Column:
    return X.number(F.regexp_extract(c, rx, group))


def standard_tier(raw: Column) -> Column:
    """Any text about size as a tier."""
    v = F.trim(raw.cast("string"))
    known = F.lower(v).rlike(U.quoted(["startup / micro", "small (11-50)", "growth smb", "mid-market", "enterprise"]))
    span = r"(\d{1,6})\s*(?:-|to)\s*(\d{1,6})"
    middle = F.floor((_num(v, span, 1) + _num(v, span, 2)) / 2)
    number = F.coalesce(middle, _num(v, r"(\d{1,6})\+"), _num(v, _N))
    empty = v.isNull() | F.lower(v).isin("unknown", "not specified", "null", "none", "undefined", "")
    return F.when(empty, "Unknown").when(known, v).otherwise(F.coalesce(size_tier(number), F.lit("Unknown")))


def size_from_prose(text: Column) -> Column:
    """struct(size, tier): head count, then team of N, range, number of stores."""
    people = rf"(?i)(?:more than|over|approx(?:imately)?|around|nearly|\+)?\s*{_N}\s*(?:\+)?\s*(?:employees|team members|staff|colleagues|workers|associates|people worldwide)\b"
    whole, n = F.regexp_extract(text, people, 0), _num(text, people)
    team = _num(text, rf"(?i)\b(?:team|workforce)\s+of\s+(?:more than\s+|over\s+)?{_N}\b")
    span = r"(?i)\b(\d{1,5})\s*(?:-|to)\s*(\d{1,5})\s*(?:employees|team members|staff|people)\b"
    low, high = _num(text, span, 1), _num(text, span, 2)
    shops = _num(text, r"(?i)\b(?:operates?|network of|over|with)\s*(\d{1,4})\s*(?:supermarkets?|hypermarkets?|stores?|retail outlets?|branches?)\b")
    places = [(25, " locations (~1,000+ staff)", TOP_TIER), (10, " locations (~250-500 staff)", TIERS[3][1]), (3, " locations (~50-150 staff)", TIERS[2][1]), (1, " store(s)", TIERS[1][1])]
    s, t = F.lit("Unknown"), F.lit("Unknown")
    for least, said, tier in reversed(places):
        s, t = F.when(shops >= least, F.concat(shops.cast("string"), F.lit(said))).otherwise(s), F.when(shops >= least, tier).otherwise(t)
    open_end = whole.rlike(r"\+|more|over")
    size = (
        F.when(n.isNotNull(), F.concat(n.cast("string"), F.when(open_end, "+").otherwise(""))).when(team.isNotNull(), team.cast("string"))
        .when(high.isNotNull(), F.concat_ws("-", low, high)).otherwise(s)
    )
    tier = F.when(n.isNotNull(), size_tier(n)).when(team.isNotNull(), size_tier(team)).when(high.isNotNull(), size_tier(F.floor((low + high) / 2))).otherwise(t)
    return F.struct(size.alias("size"), tier.alias("tier"))


def size_evidence(text: Column) -> Column:
    """struct(bucket, snippet) of the first kind of statement found, with 30 characters around it."""
    n = r"(\d{1,3}(?:,\d{3})*)"
    who = "(?:employees|people|team members|staff|engineers|professionals|headcount|members)"
    shapes = [
        (rf"(?i)\b{n}\s*(?:-|to)\s*{n}\s*{who}\b", 2), (rf"(?i)(?:company size|headcount|team size|organization size)\s*[:\-]?\s*{n}\s*(?:-|to)\s*{n}", 2),
        (rf"(?i)\b{n}\+\s*{who}\b", 1), (rf"(?i)(?:team of|over|more than|approximately|approx\.)\s*{n}\s*{who}", 1),
        (rf"(?i)headcount\s*(?:of|is|:)\s*{n}", 1), (rf"(?i)\b{n}\s*{who}\b", 1),
    ]
    hits = []
    for rx, group in shapes:
        v, at = _num(text, rx, group), F.regexp_instr(text, F.lit(rx))
        near = F.substring(text, F.greatest(at - 30, F.lit(1)), F.length(F.regexp_extract(text, rx, 0)) + F.least(at - 1, F.lit(30)) + 30)
        hits.append(F.when(v.between(1, 1_000_000), F.struct(size_bucket(v).alias("bucket"), F.replace(F.trim(near), F.lit("\n"), F.lit(" ")).alias("snippet"))))
    return F.coalesce(*hits)


def headquarters(text: Column) -> Column:
    lands = "Mauritius|United States|USA|UK|United Kingdom|Germany|France|India|Singapore|Australia|Canada|Japan|CA|NY|TX|WA|IL|FL"
    rx = rf"(?:Headquarters|HQ|Main Office|Corporate Office|Based in|Located in|Registered Office)\s*[:\-–]?\s*([A-Z][A-Za-z0-9\s,.\-]{{3,60}}(?:{lands}|\d{{5}}))"
    return X.truthy(F.rtrim(F.trim(F.regexp_extract(text, rx, 1)), F.lit(".,")))


def country_in(text: Column) -> Column:
    names = list(dict.fromkeys(U.CCTLD_COUNTRY.values()))
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(n.lower())), F.lit(n)) for n in names])


def strict_headquarters(text: Column) -> Column:
    rx = r"(?i:headquartered in|headquarters(?: is)?(?: in|:)|based in)\s+([A-Z][A-Za-z.\-]+(?:[ ,]+[A-Z][A-Za-z.\-]+){1,6})"
    found = F.trim(F.regexp_extract(text, rx, 1))
    ok = F.size(F.split(found, r"[\s,]+")).between(2, 7) & ~found.rlike(r"[a-z0-9]{14,}") & ~F.lower(found).rlike(r"\b(?:january|february|march|april|june|july|august|september|october|november|december|cookie|read more)\b")
    return F.when(ok & (found != ""), found)


def city(text: Column, gazetteer: dict[str, str]) -> Column:
    """The first entry of an ordered gazetteer (word -> canonical place) that stands in the text as a word. The gazetteer is a parameter."""
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike(rf"\b{U.quoted([w])}\b"), F.lit(place)) for w, place in gazetteer.items()])


def tech_stack(text: Column, limit: int = 6) -> Column:
    low = F.lower(text)
    hits = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in TECH.items()]))
    return F.when(F.size(hits) > 0, F.slice(hits, 1, limit)).otherwise(F.array(F.lit("Web Infrastructure")))


def tech_words(text: Column, terms: list[str], limit: int = 8) -> Column:
    low = F.lower(text)
    return F.slice(F.array_compact(F.array(*[F.when(low.rlike(rf"(?<![a-z0-9]){U.quoted([t.lower()])}(?![a-z0-9])"), F.lit(t)) for t in terms])), 1, limit)


def prose_mails(text: Column, limit: int = 3) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"), F.lit(0))
    own = F.slice(F.array_distinct(F.filter(found, lambda e: ~F.lower(e).rlike(r"example\.com|domain\.com|wixpress|sentry"))), 1, limit)
    return F.when(~F.contains(text, F.lit("@")), F.array().cast("array<string>")).otherwise(own)


def own_mails(text: Column, domain: Column) -> Column:
    """Addresses of the company's own domain."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(found, lambda e: F.endswith(F.substring_index(e, "@", -1), F.lower(domain))))


def phone(text: Column) -> Column:
    found = F.regexp_extract(text, r"(\+?\d[\d\s().\-]{6,}\d)", 1)
    return F.when(F.length(F.regexp_replace(found, r"\D", "")).between(8, 15), F.trim(found))


def founded_year(text: Column) -> Column:
    year = F.regexp_extract(text, r"(?i)(?:founded|established|est\.?)\s*(?:in|:)?\s*((?:19|20)\d{2})", 1).try_cast("int")
    return F.when(year.between(1800, 2030), year)


def executive_title(raw: Column) -> Column:
    """The ladder of executive titles, in order. 'director' holds 'cto', so a plain Director comes out as CTO: the order decides, and stays."""
    t = F.lower(raw)
    has = lambda *words: t.rlike(U.quoted(list(words)))
    ladder = [
        (has("founder") & has("ceo"), "Co-Founder & CEO"), (has("co-ceo", "co ceo"), "Co-Founder & Co-CEO"), (has("co-founder", "cofounder"), "Co-Founder"),
        (has("founder"), "Founder"), (has("ceo", "chief executive"), "Chief Executive Officer"), (has("cto", "chief technology", "chief technical"), "Chief Technology Officer"),
        (has("coo", "chief operating"), "Chief Operating Officer"), (has("cfo", "chief financial"), "Chief Financial Officer"), (has("president"), "President"),
        (has("managing director"), "Managing Director"), (has("director"), "Director"), (t.rlike(r"\bvp\b|vice president"), "Vice President"),
    ]
    out = F.when(has("managing partner", "general partner"), F.lit("Managing Partner"))
    head = F.regexp_extract(t, r"\b(head of [a-z\s]+)", 1)
    out = F.when(has("head of"), F.when(head != "", F.initcap(head)).otherwise("Head of Department")).otherwise(out)
    for hit, name in reversed(ladder):
        out = F.when(hit, name).otherwise(out)
    return F.when(F.length(raw) >= 2, out)


def person_name_ok(name: Column, company: Column) -> Column:
    """Two to four capitalised words, none of them of the web or of the company's name."""
    words = F.split(F.trim(name), r"\s+")
    low = F.lower(name)
    own = F.filter(F.split(F.lower(F.regexp_replace(F.coalesce(company, F.lit("")), r"[^\w\s]", "")), r"\s+"), lambda w: (F.length(w) >= 3) & ~w.isin("the", "and", "inc", "ltd", "com", "net", "org"))
    shape = F.forall(words, lambda w: w.rlike(r"^[A-Z][a-zA-Z.\-']{1,20}$") & ~F.lower(w).isin(NOT_NAMES))
    return F.coalesce(F.length(name).between(4, 35) & F.size(words).between(2, 4) & ~low.isin(BLOCKED_NAMES) & ~low.rlike("food recipes|cooking tips") & shape & ~F.exists(own, lambda w: F.contains(low, w)), F.lit(False))


def people(text: Column, html: Column, company: Column, limit: int = 8) -> Column:
    """array of struct(name, title, source) from 'Name, Title', 'Title: Name' and profile links, each name once, in this order."""
    one, two = rf"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){{1,2}})\b\s*[–\-,:(]{{1,3}}\s*({TITLE})", rf"\b({TITLE})\s*[–\-,:]\s*\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){{1,2}})\b"
    link = r"""href=["']https?://(?:www\.)?linkedin\.com/in/([a-zA-Z0-9\-_]+)"""

    def pairs(names: Column, titles: Column, source: str) -> Column:
        return F.transform(F.arrays_zip(names.alias("n"), titles.alias("t")), lambda x: F.struct(F.trim(x["n"]).alias("name"), executive_title(x["t"]).alias("title"), F.lit(source).alias("source")))

    every = lambda rx, g: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rx), F.lit(g))
    slugs = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(link), F.lit(1))
    linked = F.transform(slugs, lambda s: F.struct(F.array_join(F.transform(F.filter(F.split(s, "-"), lambda w: ~w.rlike(r"^\d+$") & (F.length(w) > 1)), lambda w: F.initcap(w)), " ").alias("name"), F.lit("Executive / Leadership").alias("title"), F.lit("profile_link").alias("source")))
    found = F.concat(pairs(every(one, 1), every(one, 2), "page_text"), pairs(every(two, 2), every(two, 1), "page_text"), linked)
    good = F.filter(found, lambda p: person_name_ok(p["name"], company))
    names = F.transform(good, lambda p: F.lower(p["name"]))
    first = F.filter(good, lambda p, i: F.array_position(names, F.lower(p["name"])) == i + 1)
    return F.slice(first, 1, limit)


def search_person(title: Column, snippet: Column, url: Column) -> Column:
    """struct(name, role) from a search hit: its title without the site's name, cut at dashes; else the profile's slug."""
    bare = F.trim(F.regexp_replace(title, r"(?i)\s*[|\-–]\s*linkedin.*$", ""))
    parts = F.filter(F.transform(F.split(bare, r"\s+[-–—|]\s+"), lambda x: F.trim(x)), lambda x: x != "")
    slug = F.regexp_extract(url, r"(?i)linkedin\.com/in/([a-z0-9\-]+)", 1)
    named = F.array_join(F.transform(F.filter(F.split(slug, "-"), lambda w: ~w.rlike(r"\d")), lambda w: F.initcap(w)), " ")
    role = F.coalesce(F.try_element_at(parts, F.lit(2)), X.truthy(F.regexp_extract(snippet, f"(?i)({TITLE})", 1)))
    return F.struct(F.coalesce(X.truthy(F.try_element_at(parts, F.lit(1))), X.truthy(named)).alias("name"), role.alias("role"))


def company_profile(html: Column, text: Column) -> Column:
    """The first company (else school) profile address."""
    both = F.concat_ws(" ", html, text)

    def first(kind: str) -> Column:
        slugs = F.transform(F.regexp_extract_all(both, F.lit(rf"(?i)https?://(?:www\.)?linkedin\.com/{kind}/([a-zA-Z0-9\-_]+)"), F.lit(1)), F.lower)
        slug = F.try_element_at(F.filter(slugs, lambda s: (F.length(s) >= 2) & ~s.isin(U.COMPANY_SLUGS)), F.lit(1))
        return F.when(slug.isNotNull(), F.concat(F.lit(f"https://www.linkedin.com/{kind}/"), slug))

    return F.coalesce(first("company"), first("school"))


def relevance(title: Column, snippet: Column, url: Column, domain: Column, company: Column) -> Column:
    """high: the domain is named; medium: a profile whose text names the brand; null: not about the company."""
    low, u, d = F.lower(F.concat_ws(" ", title, snippet)), F.lower(url), U.safety_domain(domain)
    brand = F.trim(F.regexp_replace(F.lower(F.regexp_replace(company, r"[^\w\s\-.]", "")), r"\.(com|co|io|ai|net|org|de|uk|fr|app|dev|tech|mu)$", ""))
    padded = F.concat(F.lit(" "), F.regexp_replace(low, r"[^\w]+", " "), F.lit(" "))
    named = F.contains(padded, F.concat(F.lit(" "), F.regexp_replace(brand, r"[^\w]+", " "), F.lit(" ")))
    return F.when((d != "") & (F.contains(u, d) | F.contains(low, d)), "high").when(F.contains(u, F.lit("linkedin.com")) & (F.length(brand) >= 3) & named, "medium")


def sector_scores(url: Column, title: Column, text: Column, sectors: dict[str, list[str]]) -> Column:
    """array of struct(score, order, sector): words of each sector in all of the page, more if they stand in address or title. sectors is a
    parameter: ordered names with their key words."""
    u, t = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    whole = F.concat_ws(" ", u, t, F.lower(F.coalesce(text, F.lit(""))))
    tokens = lambda c: F.split(c, "[^a-z0-9]+")
    out = []
    for i, (name, words) in enumerate(sectors.items()):
        single = [w for w in words if " " not in w]
        phrases = [w for w in words if " " in w]
        s = sum((F.regexp_count(whole, F.lit(rf"\b{U.quoted([w])}\b")) for w in words), F.lit(0))
        listed = F.array(*map(F.lit, single)) if single else F.array().cast("array<string>")
        s = s + F.size(F.array_intersect(listed, tokens(u))) * 5 + F.size(F.array_intersect(listed, tokens(t))) * 3
        for p in phrases:
            s = s + F.when(F.contains(u, F.lit(p)), 5).otherwise(0) + F.when(F.contains(t, F.lit(p)), 3).otherwise(0)
        out.append(F.struct(s.alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("sector")))
    return F.array(*out)


def classify_sector(url: Column, title: Column, text: Column, sectors: dict[str, list[str]], schema_type: Column | None = None, schema_types: dict[str, str] | None = None, override: Column | None = None) -> Column:
    """struct(sector, sub, confidence): given by the user, by the page's structured data, by words, by hints of the address, else general."""
    scores = sector_scores(url, title, text, sectors)
    best = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0), lambda a, x: a + x["score"])
    u = F.lower(F.coalesce(url, F.lit("")))
    make = lambda s, sub, c: F.struct((F.lit(s) if isinstance(s, str) else s).alias("sector"), F.lit(sub).alias("sub"), (F.lit(float(c)) if isinstance(c, float) else c).alias("confidence"))
    hints = [
        ([".store", ".shop", "supermarket", "mart", "grocery", "mall"], "Retail, Supermarkets & E-Commerce", "E-Commerce", 0.70),
        ([".ai", ".io", ".dev", ".tech", ".app", "software"], "Software, SaaS & Cloud Computing", "Tech Infrastructure", 0.70),
        ([".edu", ".ac."], "Education & EdTech", "Higher Education", 0.85), ([".bank", ".fin"], "Financial Services & Banking", "Banking", 0.80),
    ]
    out = make("Professional, Legal & Business Services", "Commercial Enterprise", 0.50)
    for words, sector, sub, c in reversed(hints):
        out = F.when(u.rlike(U.quoted(words)), make(sector, sub, c)).otherwise(out)
    share = X.clamp(F.round(best["score"] / F.greatest(total, F.lit(1)), 2), 0.60, 0.98)
    out = F.when(best["score"] > 0, make(best["sector"], "Corporate", share)).otherwise(out)
    if schema_type is not None and schema_types:
        known = X.label(F.regexp_replace(F.lower(schema_type), "[^a-z]", ""), schema_types)
        out = F.when(known.isNotNull(), make(known, "Schema.org Verified", 0.95)).otherwise(out)
    if override is not None:
        out = F.when(F.trim(override) != "", make(F.initcap(F.trim(override)), "General", 1.0)).otherwise(out)
    return out


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
