"""URL and host algebra as Column expressions: regular expressions only, so that no value can throw and all stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of two labels under which names are registered.
MULTI_PART_SUFFIXES = [
    "co.uk", "org.uk", "me.uk", "ltd.uk", "plc.uk", "net.uk", "sch.uk", "gov.uk", "ac.uk",
    "com.au", "net.au", "org.au", "edu.au", "gov.au", "id.au",
    "co.nz", "net.nz", "org.nz", "govt.nz", "ac.nz",
    "co.jp", "ne.jp", "or.jp", "go.jp", "ac.jp",
    "co.in", "net.in", "org.in", "gen.in", "firm.in", "ind.in",
    "com.br", "net.br", "org.br", "gov.br",
    "com.sg", "net.sg", "org.sg", "edu.sg", "gov.sg",
    "co.za", "org.za", "net.za", "gov.za",
    "com.mx", "org.mx", "net.mx", "edu.mx", "gob.mx",
    "com.my", "net.my", "org.my", "gov.my", "edu.my",
    "co.id", "net.id", "or.id", "go.id",
    "com.tr", "net.tr", "org.tr", "gov.tr",
    "co.kr", "ne.kr", "or.kr", "re.kr", "go.kr",
    "com.ar", "net.ar", "org.ar", "gov.ar",
    "com.co", "net.co", "org.co", "gov.co",
]
#: Second-last labels after which the safety rule keeps three labels.
ROOT_SECOND_LEVEL = ["co", "com", "net", "org", "gov", "ac", "edu"]
#: Suffixes of two labels known to the sub-domain classifier.
SUBDOMAIN_SUFFIXES = [
    "co.uk", "org.uk", "gov.uk", "ac.uk", "com.au", "net.au", "org.au",
    "co.in", "net.in", "org.in", "gen.in", "ind.in", "co.nz", "com.br",
    "co.za", "co.jp", "ne.jp", "com.mx", "com.sg", "co.kr",
]
#: Words that mark a sub-domain as a resource, by kind, in order of precedence.
SUBDOMAIN_KINDS = {
    "SUPPORT": ["support", "help", "service", "services", "faq", "ticket", "tickets", "desk", "servicedesk", "status", "kb", "knowledgebase"],
    "LOCATION": ["locations", "location", "stores", "store", "branches", "branch", "find", "order", "delivery", "menu", "pizza"],
    "CONTENT_RESOURCE": ["ratgeber", "magazin", "magazine", "forum", "community", "discussions", "wiki", "docs", "doc", "blog", "blogs", "news"],
    "LANGUAGE_TOOL": ["tw", "cn", "en", "de", "fr", "es", "jp", "hk", "us", "uk", "in", "ru", "pt", "it", "nl", "pl", "br", "kr", "ar", "mx"],
    "AUTH_INFRASTRUCTURE": ["login", "signin", "auth", "account", "accounts", "billing", "signup", "register", "admin", "console", "mail", "webmail", "tracking"],
}
#: Query keys that only track.
TRACKING_KEYS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid"]
#: Path hints for pages worth reading first, and for noise.
PRIORITY_HINTS = ["about", "team", "leadership", "management", "who-we-are", "contact", "company", "our-story", "founders", "board", "management-team", "our-people", "meet-the-team"]
NOISE_HINTS = ["/cart", "/checkout", "/wishlist", "/login", "/register", "/product/", "/category/", "/boutique/", "/shop/", "compare"]
#: Country of a top-level domain.
CCTLD_COUNTRY = {
    "mu": "Mauritius", "uk": "United Kingdom", "de": "Germany", "fr": "France", "ca": "Canada", "au": "Australia", "in": "India",
    "za": "South Africa", "sg": "Singapore", "ae": "United Arab Emirates", "jp": "Japan", "nl": "Netherlands", "ch": "Switzerland",
    "se": "Sweden", "no": "Norway", "dk": "Denmark", "fi": "Finland", "es": "Spain", "it": "Italy", "pt": "Portugal", "pl": "Poland",
    "ie": "Ireland", "il": "Israel", "nz": "New Zealand", "br": "Brazil", "mx": "Mexico", "ar": "Argentina", "cl": "Chile",
    "co": "Colombia", "my": "Malaysia", "id": "Indonesia", "ph": "Philippines", "th": "Thailand", "vn": "Vietnam", "kr": "South Korea",
    "ng": "Nigeria", "ke": "Kenya", "gh": "Ghana", "rw": "Rwanda", "tz": "Tanzania", "eg": "Egypt", "sa": "Saudi Arabia",
    "pk": "Pakistan", "bd": "Bangladesh", "tr": "Turkey", "at": "Austria", "be": "Belgium", "cz": "Czech Republic", "ro": "Romania",
    "gr": "Greece", "hu": "Hungary", "cn": "China", "hk": "Hong Kong", "tw": "Taiwan",
}
#: Slugs that are no profile.
PERSONAL_SLUGS = ["search", "jobs", "feed", "login", "signup", "home", "pub", "in", "sharing", "posts", "learning", "pulse", "company", "school", "help"]
COMPANY_SLUGS = ["linkedin", "home", "sharearticle", "sharing", "login", "signup", "jobs", "feed", "posts"]
#: File endings of documents and media.
DOCUMENT_ENDINGS = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".csv", ".txt"]
MEDIA_ENDINGS = [".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".mp4", ".mp3"]
FEED_NAMES = ["sitemap", "robots.txt", "feed", "rss", "atom"]

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def quoted(words: list[str]) -> str:
    """An alternation of literal words for a Java regular expression."""
    special = set(r"\.^$|?*+()[]{}")
    return "|".join("".join("\\" + c if c in special else c for c in w) for w in words)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 2))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 4)


def host(url: Column) -> Column:
    """Lower-case host without port; a missing scheme is allowed."""
    return F.lower(F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?([^/:?#]*)", 1))


def strip_www(h: Column, compat_lstrip: bool = False) -> Column:
    """One leading www. goes; with compat_lstrip every leading w and dot, as some callers of the original did."""
    return F.regexp_replace(h, r"^[w.]+" if compat_lstrip else r"^www\.", "")


def _last(labels: Column, n: int) -> Column:
    return F.array_join(F.slice(labels, -n, n), ".")


def registrable_domain(h: Column) -> Column:
    """The name that was registered: two labels, or three under a suffix of two."""
    name = strip_www(h)
    labels = F.split(name, r"\.")
    return F.when(F.size(labels) <= 2, name).otherwise(F.when(_last(labels, 2).isin(MULTI_PART_SUFFIXES), _last(labels, 3)).otherwise(_last(labels, 2)))


def safety_domain(url: Column) -> Column:
    """The host as the blocklist keeps it: scheme, port, path and every www. taken out."""
    v = F.lower(F.trim(url))
    v = F.regexp_replace(v, r"^https?://", "")
    return F.regexp_extract(F.replace(F.coalesce(v, F.lit("")), F.lit("www."), F.lit("")), r"^([^:/]*)", 1)


def root_domain(url: Column) -> Column:
    """Two labels, or three if the second-last is a common second level. Not the rule of registrable_domain."""
    d = safety_domain(url)
    labels = F.split(d, r"\.")
    n = F.size(labels)
    three = (n >= 3) & F.coalesce(F.try_element_at(labels, F.lit(-2)).isin(ROOT_SECOND_LEVEL), F.lit(False))
    return F.when(three, _last(labels, 3)).when(n >= 2, _last(labels, 2)).otherwise(d)


def canonical_domain(url: Column) -> Column:
    return F.when(F.coalesce(F.trim(url), F.lit("")) == "", "").otherwise(strip_www(host(url)))


def same_site(target: Column, base: Column) -> Column:
    """Equal hosts apart from www., or a host under the base."""
    a, b = (F.replace(host(x), F.lit("www."), F.lit("")) for x in (target, base))
    return (a != "") & (b != "") & ((a == b) | F.endswith(a, F.concat(F.lit("."), b)))


def _without_dots(p: Column) -> Column:
    """A path with its '.' and '..' steps taken."""
    none = F.array().cast("array<string>")
    taken = F.aggregate(F.split(p, "/"), none, lambda a, s: F.when(s == ".", a).when(s == "..", F.when(F.size(a) > 1, F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a)).otherwise(F.array_append(a, s)))
    out = F.concat(F.array_join(taken, "/"), F.when(p.rlike(r"(^|/)\.\.?$"), "/").otherwise(""))
    return F.when(p.rlike(r"(^|/)\.\.?(/|$)"), F.regexp_replace(F.concat(F.lit("/"), out), "^//+", "/")).otherwise(p)


def _tidy_path(full: Column) -> Column:
    # an array of one, so that the address is made once and not at each place it is looked at
    tidy = lambda x: F.concat(F.regexp_extract(x, r"^([^?#]*://[^/?#]*)", 1), _without_dots(F.regexp_extract(x, _PARTS, 3)), F.regexp_extract(x, r"^[^?#]*([?#].*)?$", 1))
    return F.element_at(F.transform(F.array(full), tidy), 1)


def resolve(url: Column, base: Column) -> Column:
    """url against base, for the relative forms that pages use; steps up and down a path are taken."""
    root = F.concat(scheme(base), F.lit("://"), F.regexp_extract(base, _PARTS, 2))
    folder = F.regexp_extract(path(base), r"^(.*/)", 1)
    clean = F.regexp_replace(base, r"[?#].*$", "")
    return (
        F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), url).when(url == "", base)
        .when(F.startswith(url, F.lit("//")), F.concat(scheme(base), F.lit(":"), url))
        .when(F.startswith(url, F.lit("/")), _tidy_path(F.concat(root, url)))
        .when(F.startswith(url, F.lit("?")), F.concat(clean, url))
        .when(F.startswith(url, F.lit("#")), F.concat(F.regexp_replace(base, r"#.*$", ""), url))
        .otherwise(_tidy_path(F.concat(root, F.when(folder == "", "/").otherwise(folder), url)))
    )


def normalize(url: Column, base: Column | None = None) -> Column:
    """Scheme and host in lower case; fragment, tracking and blank parameters and closing slashes of a path gone; null for none."""
    u = F.trim(url)
    if base is not None:
        u = F.when(u.rlike(r"^https?://"), u).otherwise(resolve(u, base))
    p = path(u)
    p = F.when(p.rlike(r"^.+/$"), F.regexp_replace(p, r"/+$", "")).otherwise(p)
    kept = F.filter(F.split(query(u), "&"), lambda kv: kv.rlike(r"^[^=]*=.") & ~F.lower(F.substring_index(kv, "=", 1)).isin(TRACKING_KEYS))
    q = F.array_join(kept, "&")
    out = F.concat(F.when(scheme(u) == "", "").otherwise(F.concat(scheme(u), F.lit("://"))), authority(u), p, F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    return F.when((F.coalesce(url, F.lit("")) == "") | (F.coalesce(u, F.lit("")) == ""), F.lit(None)).otherwise(out)


def brand(domain: Column, specials: dict[str, str] | None = None) -> Column:
    """A name made of the first label; Company if there is no dot."""
    d = canonical_domain(domain)
    first = F.substring_index(d, ".", 1)
    words = F.filter(F.split(first, r"[-_]"), lambda w: w != "")
    name = F.array_join(F.transform(words, lambda w: F.initcap(w)), " ")
    for k, v in (specials or {}).items():
        name = F.when(first == k, v).otherwise(name)
    return F.when(~F.contains(d, F.lit(".")) | (name == ""), "Company").otherwise(name)


def subdomain(url: Column) -> Column:
    """struct(root, subdomain, is_resource, kind)."""
    h = strip_www(host(url))
    labels = F.split(h, r"\.")
    n = F.size(labels)
    suffix = F.when((n >= 3) & _last(labels, 2).isin(SUBDOMAIN_SUFFIXES), 2).otherwise(1)
    deep = (n > 2) & (n > suffix + 1)
    root = F.when(deep, F.when(suffix == 2, _last(labels, 3)).otherwise(_last(labels, 2))).otherwise(h)
    sub = F.when(deep, F.array_join(F.slice(labels, F.lit(1), F.greatest(n - suffix - 1, F.lit(0))), ".")).otherwise("")
    kind = F.lit(None).cast("string")
    for name, words in reversed(SUBDOMAIN_KINDS.items()):
        hit = sub.isin(words) if name == "LANGUAGE_TOOL" else sub.rlike(rf"(?:^|[.-])(?:{quoted(words)})(?:[.-]|$)")
        kind = F.when(hit, name).otherwise(kind)
    kind = F.when(sub == "", F.lit(None)).otherwise(kind)
    return F.struct(root.alias("root"), sub.alias("subdomain"), kind.isNotNull().alias("is_resource"), kind.alias("kind"))


def link_score(url: Column, text: Column) -> Column:
    """0 for pages to read first, 2 for noise, else 1."""
    both = F.lower(F.concat_ws(" ", url, text))
    return F.when(both.rlike(quoted(PRIORITY_HINTS)), 0).when(both.rlike(quoted(NOISE_HINTS)), 2).otherwise(1)


def is_personal_profile(url: Column) -> Column:
    slug = F.lower(F.regexp_extract(url, r"(?i)https?://(?:[a-z0-9\-]+\.)?linkedin\.com/in/([a-z0-9\-_]{2,})", 1))
    return F.coalesce((slug != "") & ~slug.isin(PERSONAL_SLUGS) & ~F.lower(url).rlike("/search/|/jobs/|/posts/|/pulse/"), F.lit(False))


def is_company_profile(url: Column) -> Column:
    slug = F.lower(F.regexp_extract(url, r"(?i)https?://(?:[a-z0-9\-]+\.)?linkedin\.com/company/([a-z0-9\-_]{2,})", 1))
    return F.coalesce((slug != "") & ~slug.isin(COMPANY_SLUGS) & ~F.contains(F.lower(url), F.lit("/search/")), F.lit(False))


def company_profile_guess(domain: Column, stop: tuple[str, ...] = ("home", "index", "unknown", "company")) -> Column:
    """A profile address inferred from the first label. It is a guess: callers mark it `inferred`."""
    slug = F.regexp_replace(F.lower(F.substring_index(canonical_domain(domain), ".", 1)), "[^a-z0-9]", "")
    return F.when((F.length(slug) >= 2) & ~slug.isin(list(stop)), F.concat(F.lit("https://www.linkedin.com/company/"), slug))


def country(url: Column) -> Column:
    labels = F.split(host(url), r"\.")
    table = F.create_map(*[F.lit(x) for kv in CCTLD_COUNTRY.items() for x in kv])
    return F.when(F.size(labels) >= 2, F.try_element_at(table, F.try_element_at(labels, F.lit(-1))))


def private_host(h: Column) -> Column:
    """Hosts of private networks by pattern."""
    return F.trim(h).rlike(r"^(127\.|10\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|0\.0\.0\.0|localhost)")


def internal_address(h: Column) -> Column:
    """Literal addresses of private, loopback, link-local or reserved ranges, by their octets; IPv6 by prefix; listed host names."""
    octets = F.transform(F.split(h, r"\."), lambda x: x.try_cast("int"))
    literal = h.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(octets, lambda x: x.between(0, 255))
    a, b, c = (F.try_element_at(octets, F.lit(i)) for i in (1, 2, 3))
    ranges = [
        a.isin(0, 10, 127), (a == 172) & b.between(16, 31), (a == 192) & (b == 168), (a == 169) & (b == 254), a >= 240,
        (a == 192) & (b == 0) & c.isin(0, 2), (a == 198) & b.isin(18, 19), (a == 198) & (b == 51) & (c == 100), (a == 203) & (b == 0) & (c == 113),
    ]
    v6 = h.rlike(r"^\[?(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|2001:db8:.*)\]?$")
    return F.coalesce((literal & reduce(lambda x, y: x | y, ranges)) | v6 | h.isin("localhost", "0.0.0.0"), F.lit(False))


def ending(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(path(url), "/", -1), r"(\.[A-Za-z0-9]{1,8})$", 1))


def resource(url: Column) -> Column:
    """struct(type, mime, ending) of what a link points to."""
    e, p = ending(url), F.lower(path(url))
    mimes = {".pdf": "application/pdf", ".csv": "text/csv", ".txt": "text/plain", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".svg": "image/svg+xml"}
    table = F.create_map(*[F.lit(x) for kv in mimes.items() for x in kv])
    file = e.isin(DOCUMENT_ENDINGS + MEDIA_ENDINGS)
    feed = p.rlike(quoted(FEED_NAMES)) | e.isin(".rss", ".xml")
    kind = F.when(e.isin(DOCUMENT_ENDINGS), "document").when(e.isin(MEDIA_ENDINGS), "media").otherwise("web_resource")
    mime = F.when(file, F.coalesce(F.try_element_at(table, e), F.lit("application/octet-stream"))).when(feed, "application/xml").otherwise("text/html")
    shown = F.when(e != "", e).when(feed, ".xml").otherwise(".html")
    return F.struct(kind.alias("type"), mime.alias("mime"), shown.alias("ending"))


def resource_name(url: Column) -> Column:
    base = F.substring_index(path(url), "/", -1)
    return F.when(base != "", base).otherwise(F.concat(F.lit("resource_"), F.substring(F.md5(url.cast("binary")), 1, 8)))


def favicon(domain: Column) -> Column:
    return F.concat(F.lit("https://"), canonical_domain(domain), F.lit("/favicon.ico"))


def site_root(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def path_slug(url: Column) -> Column:
    p = F.regexp_replace(F.regexp_replace(path(url), "^/+|/+$", ""), "/", "_")
    return F.when(p == "", "homepage").otherwise(p)


def artifact_slug(name: Column) -> Column:
    s = F.regexp_replace(F.lower(name), "[^a-z0-9_-]", "_")
    return F.when(F.coalesce(s, F.lit("")) == "", "homepage").otherwise(s)


def cache_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 32)
