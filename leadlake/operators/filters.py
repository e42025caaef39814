"""The rule ladders: which pages, texts, entities and candidates are kept, and why the others are not.

Lists that grow with use (blocked hosts) are tables or parameters; the lists below are fixed values.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions import html as H
from leadlake.functions import text as X
from leadlake.functions import url as U
from leadlake.operators.ladder import Rule, first_of, first_word, fold, let, says

MIN_WORDS, MIN_TITLE, MAX_URL, MIN_CONFIDENCE = 15, 3, 500, 0.30

#: Words of disallowed content by category, in order.
DISALLOWED = {
    "adult": ["porn", "xxx", "adult", "sex", "escort", "nsfw", "camgirl", "erotica", "hentai", "xhamster", "pornhub", "onlyfans"],
    "gambling": ["casino", "betting", "poker", "slots", "sportsbook", "gambling", "roulette", "jackpot", "baccarat", "bet365", "stake.com"],
    "weapons_drugs": ["weapons", "firearms", "ammunition", "illicit drugs", "narcotics", "darknet", "darkweb", "silkroad", "dispensary", "psychedelics"],
    "counterfeit": ["crack", "keygen", "warez", "torrent", "pirated", "counterfeit", "replica", "leaked", "thepiratebay", "1337x"],
    "phishing_malware": ["phishing", "malware", "ransomware", "keylogger", "botnet", "credential-harvest", "exploit-kit", "stealer"],
    "trafficking": ["human trafficking", "escort service", "exploitation", "underage", "trafficking"],
    "extremist": ["extremist", "terrorist", "hate speech", "white supremacy", "radicalization"],
    "access_control_circumvention": ["bypass paywall", "onion site", "tor relay", "crack login", "shadow web", "proxy bypass"],
}
#: Top-level domains of media.
MEDIA_TLDS = [".news", ".blog", ".press", ".media", ".report", ".review", ".live", ".today", ".buzz", ".info", ".wiki", ".top", ".xyz", ".club"]
#: Words of media and sports in host names; words of magazines and guides.
MEDIA_WORDS = ["news", "daily", "times", "express", "gazette", "tribune", "journal", "herald", "chronicle", "sports", "casino", "lottery", "recipe", "recipes", "cricket", "football", "betting"]
GUIDE_WORDS = ["magazin", "magazine", "fibel", "ratgeber", "vergleich"]
#: First labels of hosts that are no company's front page.
SERVICE_PREFIXES = [
    "developer.", "developers.", "docs.", "doc.", "support.", "help.", "locations.", "location.", "stores.", "store.", "branches.", "branch.",
    "order.", "delivery.", "menu.", "pizza.", "api.", "download.", "downloads.", "play.", "training.", "chat.", "login.", "signin.", "auth.",
    "portal.", "console.", "admin.", "mail.", "status.", "billing.", "account.", "accounts.", "kite.", "trade.", "web.", "my.", "tracking.",
    "service.", "services.", "forum.", "community.", "discussions.", "news.", "blog.", "blogs.", "shop.", "books.",
]
#: Patterns of addresses that are no front page, looked for in the whole address.
PATH_PATTERNS = [
    r"/tag/", r"/tags/", r"/category/", r"/categories/", r"/archive/", r"/page/\d+", r"/search\?", r"\?q=", r"/feed/", r"/rss", r"/author/",
    r"/user/", r"#comment", r"/wp-content/", r"/articles/", r"/article/", r"/topic/", r"/topics/", r"/definition/", r"/blog/", r"/blogs/",
    r"/post/", r"/posts/", r"/news/", r"/course/", r"/courses/", r"/course_templates/", r"/download/", r"/downloads/", r"/store/apps/",
    r"/apk/", r"/tutorial/", r"/tutorials/", r"/lesson/", r"/lessons/", r"\.pdf$", r"\.xml$", r"\.json$", r"\.csv$",
    r"^/chat(?:/|$|\?)", r"^/login(?:/|$|\?)", r"^/signin(?:/|$|\?)", r"^/signup(?:/|$|\?)", r"^/register(?:/|$|\?)",
    r"^/discussions(?:/|$|\?)", r"/crime-news/", r"/tracking-support", r"/web/services", r"/messerrecht", r"/rechtliche-",
    r"/frage-und-antwort/", r"/continuous-", r"/our-brand/", r"/brand/", r"/brands/", r"/latest-", r"/market/", r"/markets/", r"/stocks/",
    r"/stock/", r"/opinion/", r"/editorial/", r"/read/", r"/insights/", r"/whitepaper/", r"/whitepapers/", r"/case-study/",
    r"/case-studies/", r"/events/", r"/webinar/", r"/webinars/", r"/press-release/", r"/press-releases/", r"/media-room/", r"/episodes/",
    r"/podcast/", r"/podcasts/",
]
#: Texts of parked pages, of challenges and of error titles.
SPAM_PATTERNS = [
    r"this domain is for sale", r"domain\s+parking", r"buy this domain", r"parked by", r"this website is for sale", r"click here to buy",
    r"godaddy\.com", r"sedoparking", r"domain expired", r"account suspended", r"coming soon", r"under construction", r"hello world",
    r"default web page", r"test page", r"apache2 default page", r"nginx welcome page", r"it works",
]
CHALLENGES = [
    "enable javascript to complete the security check", "additional verification required please enable javascript", "attention required! | cloudflare",
    "just a moment... cloudflare", "please enable javascript and cookies to continue", "verify you are human by completing the action",
]
ERROR_TITLES = ["404", "not found", "403", "forbidden", "500", "error", "access denied", "page not found", "file not found"]
#: Names that are titles of apps and articles, of news, and how articles begin.
ARTICLE_TERMS = [
    "apps on google play", "download apk", "apk for android", "watch free", "predictions and futures", "college football",
    "getting started |", "security checkpoint", "just a moment...", "checking your browser", "human verification",
    "learning management system", "roadmap to", "watch movies", "cartoons online", "login to", "sign in to", "wrongfully convicted",
    "leaderboard", "rankings for", "download for", "where's my package", "where is my package", "tracking support", "gesetzgebung",
    "waffengesetz", "vorabinformation", "ai chat -", "ai chat |", "ai leaderboard", "iso download", "digital seva portal", "books online",
    "google books", "paragraf", "messerrecht",
]
NEWS_TERMS = [
    "business news", "stock market", "sensex", "nifty", "bse/nse", "live updates", "latest updates", "breaking news", "live news",
    "official website", "official site", "buy & sell", "designer clothes", "healthy fruit", "fruit juices", "power juices",
    "continuous integration", "continuous delivery", "real madrid", "fc barcelona", "right news", "financial express", "zee business",
    "moneycontrol", "live score", "test series", "real test", "news today", "latest news",
]
ARTICLE_STARTS = [
    "what is ", "what are ", "what does ", "how to ", "definition of ", "guide to ", "introduction to ", "tutorial: ", "key concepts of ",
    "top 10 ", "best 10 ", "top 5 ", "best 5 ", "versus ", "how-to ",
]
JUNK_NAMES = r"^\d+$|^http|^www\.|^(?:null|none|n/a|na|unknown|unnamed|untitled|book|home|index|login|sign in|sign up|\.|\.\.)$|^(?:company|organization|startup|firm|inc|llc|ltd)$"
LISTICLE = r"\b\d+\s+(?:best|top|profitable|popular|free|ways|ideas|tools|apps|saas|plugins|alternatives)\b"
#: Patterns of candidates that are no company.
SPORTS = [
    r"\blive scores?\b", r"\bmatch stats?\b", r"\bfixtures\b", r"\bmatchday\b", r"\bfootball\b", r"\bnfl\b", r"\bnba\b", r"\bsoccer\b",
    r"\bcricket\b", r"\bbetting odds\b", r"\bsports predictions?\b", r"\bleague table\b", r"\bpremier league\b",
    r"\bsports storytelling\b", r"\blive match commentary\b",
]
GOVERNMENT_HOSTS = [".gov", ".mil", ".gov.uk", ".gov.in", ".gov.au", ".regeringen.se", ".admin.ch"]
GOVERNMENT = [r"\bmyndighet(?:en)?\b", r"\bstatlig\b", r"\bministry of\b", r"\bdepartment of\b", r"\bpublic authority\b", r"\bgovernment agency\b", r"\bmunicipality\b"]
EDITORIAL = [
    r"\bbreaking news\b", r"\bdaily news\b", r"\bjournalism\b", r"\bop-ed\b", r"\bopinion column\b", r"\bcelebrity gossip\b",
    r"\bnews headlines\b", r"\bmagazine subscription\b", r"\bpress releases? wire\b",
]
FRANCHISE = [
    r"\bhundreds of locations\b", r"\bthousands of locations\b", r"\b\d+[\+,]\d*\s*locations\b", r"\bover \d+ locations\b",
    r"\bglobal franchise\b", r"\binternational franchise\b", r"\brestaurant chain\b", r"\bfast food chain\b", r"\bsupermarket chain\b",
    r"\bretail chain\b", r"\bpizza chain\b", r"\bfind a store near you\b", r"\bfind a location near you\b",
    r"\border delivery or carryout\b", r"\bget food delivery\b",
]
ENTERPRISE = [
    "fortune 500", "fortune 100", "fortune 1000", "s&p 500", "nasdaq:", "nyse:", "lse:", "euronext:", "multinational conglomerate",
    "multinational corporation", "publicly traded company", "publicly traded conglomerate", "10,000+ employees", "5,000+ employees",
    "over 1,000 employees", "1,000+ employees", "over 500 employees", "500+ employees", "20,000+ employees", "50,000+ employees",
    "tens of thousands of employees",
]
STARTUP = ["startup", "seed round", "series a", "series b", "early stage", "growth stage", "bootstrapped", "founded in 20", "incubated", "y combinator", "techstars", "smb", "small business"]
#: Media words of descriptions and names.
MEDIA_PHRASES = ["news portal", "latest news", "breaking news", "daily news", "read our blog", "welcome to my blog", "vlog", "magazine", "journal", "publication", "news agency", "recipes", "food guide", "lifestyle blog"]
#: Addresses of listings and of single entities.
LISTING_URLS = [
    r"crunchbase\.com/organizations", r"crunchbase\.com/hub", r"crunchbase\.com/discover", r"ycombinator\.com/companies",
    r"angel\.co/companies", r"angellist\.com/companies", r"tracxn\.com/d/", r"tracxn\.com/explore", r"g2\.com/categories",
    r"g2\.com/compare", r"capterra\.com/[\w-]+software", r"clutch\.co/directory", r"clutch\.co/agencies", r"clutch\.co/developers",
    r"clutch\.co/it-services", r"producthunt\.com/topics", r"producthunt\.com/collections", r"getapp\.com/[\w-]+",
    r"softwareadvice\.com/[\w-]+", r"techcrunch\.com/startups", r"forbes\.com/lists", r"inc\.com/\d+", r"builtinchicago\.org/companies",
    r"builtinsf\.org/companies", r"builtinnyc\.com/companies", r"builtin\.com/companies", r"ventureradar\.com",
    r"cbinsights\.com/research", r"pitchbook\.com", r"startupranking\.com", r"dealroom\.co", r"sifted\.eu/sector", r"eu-startups\.com",
    r"seedtable\.com", r"craft\.co/industry", r"owler\.com/search", r"apollo\.io/companies", r"zoominfo\.com/c/", r"mattermark\.com",
    r"github\.com/topics", r"alternativeto\.net", r"slashdot\.org/software",
]
ENTITY_URLS = [r"linkedin\.com/company/[^/]+/?$", r"crunchbase\.com/organization/[^/]+/?$", r"angellist\.com/company/[^/]+/?$", r"github\.com/[^/]+/?$"]
LISTING_WORDS = ["compare", "directory", "all companies", "startups list", "top 10", "best companies", "filter by", "showing results", "view all", "explore more", "browse all"]
ENTITY_WORDS = ["our mission", "about us", "contact us", "our team", "our products", "careers at", "founded in", "headquarters", "privacy policy", "terms of service"]
LISTING_TITLES = ["list", "directory", "top ", "best ", "compare", "companies", "tools"]
#: Texts that stand for no value.
NO_VALUE = ["unknown", "not found", "none", "null", "n/a", "undefined"]
#: What must be tried before a field counts as not found: sources, kinds of source, searches.
FIELD_NEEDS = {
    "industry_sector": (4, ["homepage", "about_or_company", "search_domain"], 1),
    "location_region": (3, ["contact_or_locations", "about_or_company", "search_location"], 1),
    "company_size_tier": (3, ["about_or_company", "careers_or_team", "search_size"], 1),
    "verified_contact_email": (3, ["contact_page", "footer_or_body", "search_email"], 1),
    "raw_storage_vault_path": (1, ["storage_backend"], 0),
    "crawled_page_text": (1, ["crawler_storage"], 0),
    "extracted_word_count": (1, ["content_recalculation"], 0),
    "company_linkedin_url": (1, ["social_links_or_text"], 0),
}


def disallowed_category(c: Column) -> Column:
    """The first category with a word in the text (plain substrings), null if none. The text is lowered once."""
    any_of = lambda low, words: reduce(or_, [F.contains(low, F.lit(w)) for w in words])
    return let(F.lower(c), lambda low: F.coalesce(*[F.when(any_of(low, words), F.lit(name)) for name, words in DISALLOWED.items()]))


def url_rules(url: Column, blocked: Column | None = None, blacklisted: list[str] | None = None) -> list[Rule]:
    """blocked: whether the host is in the blocklist table (see blocklist()); blacklisted: host names whose sub-domains go too."""
    h = U.strip_www(U.host(url))
    low = F.lower(url)
    tld = rf"(?:{U.quoted(MEDIA_TLDS)})(?:\.|$)"
    category, pattern = disallowed_category(url), first_of(low, PATH_PATTERNS)
    rules = [
        Rule("FORMAT", ~F.coalesce(F.startswith(url, F.lit("http")), F.lit(False)), "Invalid URL format"),
        Rule("LENGTH", F.length(url) > MAX_URL, says("URL too long (%s chars)", F.length(url).cast("string"))),
        Rule("PRIVATE", U.internal_address(U.host(url)), says("Private or restricted host: %s", U.host(url))),
        Rule("EDU_GOV", h.rlike(r"\.(edu|gov)(\.|$)"), says("Non-commercial domain: %s", h)),
        Rule("MEDIA_TLD", h.rlike(tld), says("News or media top-level domain: %s", h)),
        Rule("MEDIA_HOST", h.rlike(rf"(?:^|[.\-])(?:{'|'.join(MEDIA_WORDS)})(?:[.\-]|$)"), says("News or sports host: %s", h)),
        Rule("CATEGORY", category.isNotNull(), says("Disallowed category '%s': %s", category, h)),
        Rule("GUIDE", h.rlike("|".join(GUIDE_WORDS)), says("Magazine or guide host: %s", h)),
        Rule("SERVICE_HOST", h.rlike(rf"^(?:{U.quoted(SERVICE_PREFIXES)})"), says("Service sub-domain: %s", h)),
        Rule("PATH", pattern.isNotNull(), says("Blacklisted URL pattern: %s", pattern)),
        Rule("NO_TLD", ~F.contains(h, F.lit(".")), "No TLD in domain"),
    ]
    if blocked is not None:
        rules.insert(6, Rule("BLOCKED", blocked, says("Blocked domain: %s", h)))
    if blacklisted:
        rules.insert(7 + (blocked is not None), Rule("BLACKLISTED", h.rlike(rf"(?:^|\.)(?:{U.quoted(blacklisted)})$"), says("Blacklisted domain: %s", h)))
    return rules


def filter_url(url: Column, blocked: Column | None = None, blacklisted: list[str] | None = None) -> Column:
    return fold(url_rules(url, blocked, blacklisted))


def filter_content(text: Column, title: Column, words: Column) -> Column:
    low, head = F.lower(text), F.lower(title)
    spam, challenge, error = first_of(low, SPAM_PATTERNS), first_word(low, CHALLENGES), first_word(head, ERROR_TITLES)
    return fold([
        Rule("THIN", words < MIN_WORDS, says("Thin content (%s words)", words.cast("string"))),
        Rule("NO_TITLE", title.isNull() | (F.length(F.trim(title)) < MIN_TITLE), "Missing or empty page title"),
        Rule("SPAM", spam.isNotNull(), says("Parked page: matched '%s'", spam)),
        Rule("CHALLENGE", challenge.isNotNull(), says("Challenge page: '%s'", challenge)),
        Rule("ERROR_TITLE", error.isNotNull(), says("Error page: title contains '%s'", error)),
    ])


def filter_entity(name: Column, url: Column, confidence: Column) -> Column:
    n = F.trim(name)
    low, u = F.lower(n), F.lower(F.trim(url))
    words = F.size(F.split(n, r"\s+"))
    return fold([
        Rule("MISSING", F.coalesce(name, F.lit("")) == "", "Entity name missing"),
        Rule("SHORT", F.length(n) < 3, says("Entity name too short: '%s'", name)),
        Rule("NO_LETTER", ~n.rlike("[a-zA-Z]"), says("Entity name has no letters: '%s'", name)),
        Rule("PUNCTUATION", n.rlike(r"^[.,\-_/?:;!#$%^&*()=+<>{}\[\]]+$"), says("Punctuation-only name: '%s'", name)),
        Rule("HEX", n.rlike("^[0-9a-fA-F]{8,}$"), says("Hash as name: '%s'", name)),
        Rule("QUESTION", F.contains(name, F.lit("?")), says("Question as name: '%s'", name)),
        Rule("LISTICLE", low.rlike(LISTICLE), says("Listicle as name: '%s'", name)),
        Rule("ARTICLE", low.rlike(U.quoted(ARTICLE_TERMS)), says("Application or article title: '%s'", name)),
        Rule("SENTENCE", (words > 6) | (F.length(n) > 50), says("Name is a sentence (%s words): '%s'", words.cast("string"), name)),
        Rule("NEWS", low.rlike(U.quoted(NEWS_TERMS)), says("News title: '%s'", name)),
        Rule("GUIDE", low.rlike(rf"^(?:{U.quoted(ARTICLE_STARTS)})"), says("Guide title: '%s'", name)),
        Rule("JUNK", low.rlike(JUNK_NAMES), says("Junk name: '%s'", name)),
        Rule("CONFIDENCE", confidence < MIN_CONFIDENCE, says("Low confidence: %s", F.format_number(confidence, 2))),
        Rule("NO_URL", F.coalesce(url, F.lit("")) == "", "Entity has no URL"),
        Rule("SCHEME", ~u.rlike("^https?://"), says("Invalid URL scheme: '%s'", url)),
        Rule("JUNK_URL", F.contains(u, F.lit("undefined")) | F.endswith(u, F.lit("/.")), says("Junk URL: '%s'", url)),
    ])


_N = r"(\d{1,3}(?:,\d{3})+|\d+)"


def qualify(title: Column, snippet: Column, url: Column, blocked: Column | None = None, blacklisted: list[str] | None = None) -> Column:
    """struct(qualified, rule_id, reason, candidate_type, company_size, priority) of a search hit."""
    said = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit(""))))
    sub, page, h = U.subdomain(url), filter_url(url, blocked, blacklisted), U.authority(url)
    sport, gov, edit, chain, big = first_of(said, SPORTS), first_of(said, GOVERNMENT), first_of(said, EDITORIAL), first_of(said, FRANCHISE), first_word(said, ENTERPRISE)
    span = rf"\b{_N}\s*(?:-|to)\s*{_N}\s*(?:employees|people|staff|team members)\b"
    low, high = X.number(F.regexp_extract(said, span, 1)), X.number(F.regexp_extract(said, span, 2))
    one = F.when(high.isNull(), X.number(F.regexp_extract(said, rf"\b{_N}\+?\s*(?:employees|people|staff)\b", 1)))
    verdict = fold([
        Rule("SUBDOMAIN_RESOURCE", sub["is_resource"], says("Sub-domain resource (%s)", sub["kind"])),
        Rule("INVALID_URL", ~page["keep"], page["reason"]),
        Rule("SPORTS_MEDIA", sport.isNotNull(), says("Sports or scores: '%s'", sport)),
        Rule("GOVERNMENT_AGENCY", h.rlike(rf"(?:{U.quoted(GOVERNMENT_HOSTS)})$"), says("Government host: %s", h)),
        Rule("GOVERNMENT_AGENCY", gov.isNotNull(), says("Government authority: '%s'", gov)),
        Rule("MEDIA_EDITORIAL", edit.isNotNull(), says("Editorial or news: '%s'", edit)),
        Rule("FRANCHISE_CHAIN", chain.isNotNull(), says("Franchise or chain: '%s'", chain)),
        Rule("LARGE_ENTERPRISE", big.isNotNull(), says("Enterprise: '%s'", big)),
        Rule("LARGE_ENTERPRISE", low > 200, says("Exceeds 200 employees (%s-%s)", low.cast("string"), high.cast("string"))),
        Rule("LARGE_ENTERPRISE", one > 200, says("Exceeds 200 employees (%s+)", one.cast("string"))),
    ])
    young = said.rlike(U.quoted(STARTUP))
    known = F.struct(verdict.alias("v"), big.isNull().alias("no_name"), low.alias("low"), high.alias("high"), one.alias("one"), young.alias("young"))

    def described(k: Column) -> Column:
        rule, keep = k["v"]["rule_id"], k["v"]["keep"]
        span = F.concat_ws("-", k["low"], k["high"])
        size = (
            F.when(rule.isin("FRANCHISE_CHAIN"), ">200").when((rule == "LARGE_ENTERPRISE") & k["no_name"] & k["high"].isNotNull(), span)
            .when(rule == "LARGE_ENTERPRISE", ">200").when(~keep, "UNKNOWN")
            .when(k["high"].isNotNull(), span).when(k["one"] > 1, F.concat(F.lit("1-"), k["one"].cast("string"))).when(k["one"].isNotNull(), "1")
            .when(k["young"], "UNKNOWN (Startup Indicator)").otherwise("UNKNOWN")
        )
        priority = (
            F.when(rule.isin("FRANCHISE_CHAIN", "LARGE_ENTERPRISE"), "DEPRIORITIZED").when(~keep, "REJECTED")
            .when((k["high"] <= 200) | (k["one"] <= 200) | k["young"], "HIGH").otherwise("NORMAL")
        )
        kind = F.when(keep, "COMPANY").otherwise(rule)
        return F.struct(keep.alias("qualified"), rule.alias("rule_id"), k["v"]["reason"].alias("reason"), kind.alias("candidate_type"), size.alias("company_size"), priority.alias("priority"))

    # inside a lambda, so that the rules are evaluated once, not at each use of their verdict
    return F.get(F.transform(F.array(known), described), F.lit(0))


def classify_url(url: Column) -> Column:
    low = F.lower(url)
    return F.when(low.rlike("|".join(LISTING_URLS)), "listing").when(low.rlike("|".join(ENTITY_URLS)), "entity").otherwise("unknown")


def classify_page(url: Column, html: Column, text: Column) -> Column:
    """struct(kind, confidence): by address, else by signals of links, words and title. What the signals share is made once."""
    hrefs = F.regexp_extract_all(html, F.lit(r"""(?i)href=["']([^"']+)["']"""), F.lit(1))
    away = let(U.authority(url), lambda own: F.size(F.filter(hrefs, lambda h: F.startswith(h, F.lit("http")) & (U.authority(h) != own))))
    title = F.lower(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    some = lambda c: F.coalesce(c, F.lit(False))
    count = lambda low, words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    steps = lambda c, two, one: F.when(c >= two, 2).when(c >= one, 1).otherwise(0)
    words = let(F.lower(text), lambda low: F.struct(count(low, LISTING_WORDS).alias("lists"), count(low, ENTITY_WORDS).alias("owns")))
    seen = F.struct(
        some(html != "").alias("html"), some(text != "").alias("text"), some(html.rlike(r"(?is)<title[^>]*>.*?</title>")).alias("titled"),
        away.alias("away"), words.alias("w"), some(title.rlike("|".join(LISTING_TITLES))).alias("listed"),
    )

    def by_signals(s: Column) -> Column:
        lists, owns = s["w"]["lists"], s["w"]["owns"]
        hit = F.when(s["html"], steps(s["away"], 21, 11)).otherwise(0) + F.when(s["text"], steps(lists, 3, 1) + F.when(owns == 0, 1).otherwise(0)).otherwise(0)
        hit = hit + F.when(s["titled"] & s["listed"], 1).otherwise(0)
        total = F.when(s["html"], 2).otherwise(0) + F.when(s["text"], 2 + steps(owns, 3, 1)).otherwise(0) + s["titled"].cast("int")
        ratio = lambda t: t["hit"] / F.greatest(t["total"], F.lit(1))
        sure = lambda t: F.least(F.lit(0.95), 0.6 + F.abs(ratio(t) - 0.5) * 0.6)
        return let(F.struct(hit.alias("hit"), total.alias("total")), lambda t: F.struct(
            F.when(t["total"] == 0, "entity").when(ratio(t) >= 0.5, "listing").otherwise("entity").alias("kind"), F.when(t["total"] == 0, F.lit(0.5)).otherwise(sure(t)).alias("confidence"),
        ))

    of = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("confidence"))
    return let(classify_url(url), lambda by: F.when(by == "listing", of("listing", 0.95)).when(by == "entity", of("entity", 0.90)).otherwise(let(seen, by_signals)))


def media_or_blog(name: Column, description: Column) -> Column:
    return F.coalesce(F.lower(F.concat_ws("\n", name, description)).rlike(U.quoted(MEDIA_PHRASES)), F.lit(False))


def valid_fact(value: Column, evidence: Column, domain: Column) -> Column:
    """Whether evidence supports value: the whole value, or each of its longer words, and not the domain's name alone."""
    v, e = F.lower(F.trim(value)), F.lower(evidence)
    words = F.filter(F.split(v, r"(?U)\W+"), lambda t: F.length(t) > 2)
    backed = F.contains(e, v) | ((F.size(words) > 0) & F.forall(words, lambda t: F.contains(e, t)))
    from_name = v == F.substring_index(F.replace(F.lower(domain), F.lit("www."), F.lit("")), ".", 1)
    return F.coalesce((v != "") & ~v.isin(NO_VALUE) & (F.trim(evidence) != "") & backed & ~F.coalesce(from_name, F.lit(False)), F.lit(False))


def can_mark_not_found(field: Column, inv: Column) -> Column:
    """struct(keep, rule_id, reason) with keep if the search for a field is over. inv: infra_failure, sources_checked, search_attempts,
    strategies_exhausted, evidence_found."""
    table = F.create_map(*[y for k, (n, kinds, s) in FIELD_NEEDS.items() for y in (F.lit(k), F.struct(F.lit(n).alias("sources"), F.array(*map(F.lit, kinds)).alias("kinds"), F.lit(s).alias("searches")))])
    need = F.try_element_at(table, field)
    seen = F.coalesce(F.array_distinct(inv["sources_checked"]), F.array().cast("array<string>"))
    missing = F.filter(need["kinds"], lambda k: ~F.exists(seen, lambda s: F.contains(s, k)))
    tries = F.coalesce(inv["search_attempts"], F.lit(0))
    return fold([
        Rule("NO_RECORD", inv.isNull(), "Investigation record missing"),
        Rule("INFRA", F.coalesce(inv["infra_failure"], F.lit("")) != "", says("Blocked by infrastructure failure: %s", inv["infra_failure"])),
        Rule("UNKNOWN_FIELD", need.isNull(), says("Unknown field '%s'", field)),
        Rule("SOURCES", F.size(seen) < need["sources"], says("Insufficient sources checked (%s)", F.size(seen).cast("string"))),
        Rule("KINDS", F.size(missing) > 0, says("Missing source type '%s'", F.try_element_at(missing, F.lit(1)))),
        Rule("SEARCHES", tries < need["searches"], says("Insufficient searches (%s)", tries.cast("string"))),
        Rule("OPEN", ~F.coalesce(inv["strategies_exhausted"], F.lit(False)), "Strategies not exhausted"),
        Rule("FOUND", F.coalesce(inv["evidence_found"], F.lit(False)), "Evidence was found"),
    ])


def http_route(status: Column) -> Column:
    return F.when(status.isin(403, 429), "BLOCKED_NEEDS_ALTERNATIVE_EVIDENCE").when(status >= 400, "FILTERED").otherwise("CRAWLED_PENDING_AGENT_2")


def headquarters_or_null(c: Column) -> Column:
    """Null for text that is a hash or an identifier rather than a place."""
    odd = c.rlike(r"[a-z0-9]{12,}") | c.rlike(r"(?:[a-z][A-Z]){3,}") | (F.size(F.split(F.trim(c), r"\s+")) < 2)
    return F.when(~odd, c)


def moderate(text: Column, score: Column | None = None) -> Column:
    """struct(flagged, ambiguous, score, category): by words, else by an outside score if given, else safe."""
    category = disallowed_category(text)
    s = F.when(category.isNotNull(), 0.99).otherwise(F.lit(0.10) if score is None else F.coalesce(score, F.lit(0.99)))  # fail closed
    return F.struct((s > 0.70).alias("flagged"), s.between(0.30, 0.70).alias("ambiguous"), s.alias("score"), category.alias("category"))


def moderation_route(m: Column) -> Column:
    return F.when(m["ambiguous"], "REVIEW_QUEUE").when(m["flagged"], "QUARANTINE_AND_BLOCK").otherwise("PASS")


def blocklist(df: DataFrame, url: str, blocked: DataFrame) -> DataFrame:
    """df with is_blocked: host or root in blocked(domain). Two look-ups in the distinct list; no row of df is multiplied."""
    listed = blocked.select(F.lower("domain").alias("_key")).where("_key is not null").distinct()
    by_host = listed.select(F.col("_key").alias("_host"), F.lit(True).alias("_on_host"))
    by_root = listed.select(F.col("_key").alias("_root"), F.lit(True).alias("_on_root"))
    out = df.withColumn("_host", U.safety_domain(F.col(url))).withColumn("_root", U.root_domain(F.col(url)))
    out = out.join(by_host, "_host", "left").join(by_root, "_root", "left")
    return out.select(*df.columns, F.coalesce("_on_host", "_on_root", F.lit(False)).alias("is_blocked"))


def robots(df: DataFrame, url: str, rules: DataFrame) -> DataFrame:
    """df with allowed, from robots(host, disallow) prefixes; hosts without a row are allowed."""
    h = rules.groupBy("host").agg(F.collect_set("disallow").alias("_no"))
    out = df.withColumn("_h", U.host(F.col(url))).join(h, F.col("_h") == h.host, "left")
    hit = F.exists(F.coalesce("_no", F.array().cast("array<string>")), lambda p: F.startswith(U.path(F.col(url)), p))
    return out.withColumn("allowed", ~hit).drop("_h", "_no", "host")


def page_columns(pages: DataFrame) -> DataFrame:
    """pages (url, html) with host, domain, title, text and words: the scan that the other plans share."""
    out = pages.withColumn("host", U.host(F.col("url"))).withColumn("domain", U.registrable_domain(F.col("host")))
    out = out.withColumn("title", H.title(F.col("html"))).withColumn("text", H.clean_text(F.col("html")))
    return out.withColumn("words", X.words_split(F.col("text")))
