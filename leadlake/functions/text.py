"""Strings, numbers, dates, arrays and maps as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlake.functions.url import quoted

#: Aliases of countries.
COUNTRY_ALIASES = {
    "us": "United States", "usa": "United States", "united states of america": "United States",
    "uk": "United Kingdom", "gb": "United Kingdom", "great britain": "United Kingdom", "in": "India", "ind": "India",
    "mu": "Mauritius", "mus": "Mauritius", "de": "Germany", "deu": "Germany", "deutschland": "Germany", "fr": "France", "fra": "France",
    "ca": "Canada", "can": "Canada", "au": "Australia", "aus": "Australia", "za": "South Africa", "zaf": "South Africa",
    "sg": "Singapore", "sgp": "Singapore", "ae": "United Arab Emirates", "uae": "United Arab Emirates", "jp": "Japan", "jpn": "Japan",
    "nl": "Netherlands", "nld": "Netherlands", "ch": "Switzerland", "che": "Switzerland", "se": "Sweden", "swe": "Sweden",
    "nz": "New Zealand", "nzl": "New Zealand", "br": "Brazil", "bra": "Brazil", "mx": "Mexico", "mex": "Mexico", "ie": "Ireland",
    "irl": "Ireland", "es": "Spain", "esp": "Spain", "it": "Italy", "ita": "Italy", "cn": "China", "chn": "China",
    "kr": "South Korea", "kor": "South Korea", "ng": "Nigeria", "nga": "Nigeria", "ke": "Kenya", "ken": "Kenya",
}
#: Legal forms that are no part of a name.
LEGAL_FORMS = r"(?i)\b(inc\.?|incorporated|llc\.?|ltd\.?|limited|corp\.?|corporation|co\.?|company|group|holdings|gmbh|ag|plc|sa|sas|bv|nv|oy|ab)\b"
#: Page titles that name no company.
GENERIC_TITLES = [
    "home", "homepage", "home page", "index", "welcome", "welcome to", "main", "login", "sign in", "signup", "sign up", "portal",
    "default web page", "official portal", "official website", "official site", "untitled", "unknown", "dashboard", "landing page",
    "contact us", "about us", "page",
]
#: Shapes in which secrets stand in log lines.
SECRETS = [
    r"""(?i)(password[:=]\s*["']?)([^"'\s&]+)(["']?)""", r"""(?i)(secret[:=]\s*["']?)([^"'\s&]+)(["']?)""", r"""(?i)(api[_-]?key[:=]\s*["']?)([^"'\s&]+)(["']?)""",
    r"""(?i)(token[:=]\s*["']?)([^"'\s&]+)(["']?)""", r"""(?i)(auth[:=]\s*["']?Bearer\s+)([^"'\s&]+)(["']?)""", r"(?i)(postgresql://[^:]+:)([^@]+)(@)", r"(?i)(redis://:)([^@]+)(@)",
]
#: Terms that no search may hold.
PROHIBITED_TERMS = ["hack", "crack", "torrent", "warez", "exploit", "nude", "porn", "illegal", "phishing", "malware", "scam"]

SEPARATORS = r"[-–—|:•·]"


def truthy(c: Column) -> Column:
    """Null for what counts as missing: null, empty after trimming."""
    return F.when(F.trim(c) != "", c)


def first_truthy(*cols: Column) -> Column:
    return F.coalesce(*[truthy(c) for c in cols])


def first_filled(*arrays: Column) -> Column:
    return F.coalesce(*[F.when(F.size(a) > 0, a) for a in arrays])


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


#: Entities that pages use most; numbers are decoded by rule, &amp; last of all.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "bull": "•", "eacute": "é", "egrave": "è", "agrave": "à", "uuml": "ü", "ouml": "ö", "auml": "ä", "szlig": "ß", "ntilde": "ñ", "ccedil": "ç", "amp": "&"}


def _numbered(entity: Column) -> Column:
    """The character of &#n; or &#xh;, the entity itself if it has none."""
    hexed = F.regexp_extract(entity, r"(?i)^&#x0*([0-9a-f]{1,6});$", 1)
    plain = F.regexp_extract(entity, r"^&#0*([0-9]{1,7});$", 1)
    code = F.when(hexed != "", F.conv(hexed, 16, 10)).otherwise(plain).try_cast("int")
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(entity)


def unescape(c: Column) -> Column:
    """Common named entities and all numbers; the ampersand last, so nothing is decoded twice. A fold, since a chain of calls outgrows a JVM
    method; only the entities that a text holds are replaced."""
    known = F.array(*[F.struct(F.lit(f"&{k};").alias("k"), F.lit(v).alias("v")) for k, v in ENTITIES.items()])
    numbers = F.filter(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(&#(?:[0-9]+|[xX][0-9a-fA-F]+);)"), F.lit(1))), lambda e: _numbered(e) != "&")
    shown = F.aggregate(numbers, c, lambda t, e: F.replace(t, e, _numbered(e)))
    named = F.aggregate(known, shown, lambda t, e: F.when(F.contains(t, e["k"]), F.replace(t, e["k"], e["v"])).otherwise(t))
    last = F.regexp_replace(named, r"&#(?:0*38|[xX]0*26);", "&")
    return F.when(F.contains(c, F.lit("&")), F.when(F.contains(c, F.lit("&#")), last).otherwise(named)).otherwise(c)


def normalize_string(c: Column) -> Column:
    return truthy(collapse(unescape(c)))


def unescape_all(spark_type: str = "string"):
    """Every HTML entity, for text where the common ones are not enough: Arrow batches."""
    from pyspark.sql.pandas.functions import PandasUDFType

    @F.pandas_udf(spark_type, PandasUDFType.SCALAR)
    def run(s):
        import html

        return s.map(lambda x: None if x is None else html.unescape(x))

    return run


def normalize_language(c: Column) -> Column:
    return truthy(F.substring(F.substring_index(F.lower(F.trim(c)), "-", 1), 1, 10))


def normalize_country(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in COUNTRY_ALIASES.items() for x in kv])
    return F.when(F.trim(c) != "", F.coalesce(F.try_element_at(table, F.lower(F.trim(c))), F.initcap(F.trim(c))))


def normalize_phone(c: Column) -> Column:
    digits = F.regexp_replace(c, r"[^\d+]", "")
    return F.when(c != "", F.when(F.length(digits) >= 7, digits).otherwise(F.trim(c)))


def normalize_email(c: Column) -> Column:
    e = F.lower(F.trim(c))
    return F.when(e.rlike(r"^[\w.-]+@[\w.-]+\.\w+$"), e)


def company_key(name: Column) -> Column:
    """A company's name without legal forms, for look-ups."""
    bare = F.trim(F.regexp_replace(name, LEGAL_FORMS, ""), F.lit(" ,.-"))
    return F.lower(F.regexp_replace(bare, r"\s+", " "))


def segments(title: Column) -> Column:
    return F.filter(F.transform(F.split(title, SEPARATORS), lambda x: F.trim(x)), lambda x: x != "")


def company_identity(url_brand: Column, title: Column, raw_name: Column) -> Column:
    """The first part of the title (else of the given name) that is not generic, without greetings; else the brand of the domain."""
    greeting = r"(?i)^(?:welcome\s+to|welcome|home\s+of|official\s+website\s+of|about\s+us\s*[-–—|:]|about)\s+"
    telling = F.filter(segments(title), lambda x: ~F.lower(x).isin(GENERIC_TITLES))
    usable = F.coalesce(F.length(F.try_element_at(telling, F.lit(1))) > 2, F.lit(False))
    candidate = F.when(usable, F.trim(title)).otherwise(F.coalesce(truthy(F.trim(raw_name)), truthy(F.trim(title)), F.lit("")))
    clean = F.trim(F.regexp_replace(candidate, greeting, ""))
    found = F.try_element_at(F.filter(segments(clean), lambda x: ~F.lower(x).isin(GENERIC_TITLES)), F.lit(1))
    return F.when(F.length(found) >= 2, found).otherwise(url_brand)


def sanitize_secrets(c: Column) -> Column:
    return reduce(lambda x, rx: F.regexp_replace(x, rx, "$1***REDACTED***$3"), SECRETS, c)


def sanitize_query(c: Column) -> Column:
    """The trimmed search, null if it is short or holds a prohibited term."""
    return F.when((F.length(F.trim(c)) >= 3) & ~F.lower(c).rlike(quoted(PROHIBITED_TERMS)), F.trim(c))


def words_regex(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"(?U)\b\w+\b"))


def words_split(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != ""))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")


#: Words of cookie banners and menus.
BOILERPLATE = ["cookie", "javascript", "privacy policy", "terms of", "all rights reserved", "sign in", "log in", "subscribe"]


def overview(description: Column, text: Column, name: Column) -> Column:
    """A summary: the description if it says something, else two telling sentences, else a template."""
    lively = lambda x: ~F.lower(x).rlike(quoted(BOILERPLATE))
    good = (F.length(F.trim(description)) > 30) & ~F.lower(description).rlike("cookie|javascript")
    told = F.array_join(F.slice(F.filter(sentences(text), lambda x: (F.length(x) > 30) & lively(x)), 1, 2), " ")
    return F.when(good, F.trim(description)).otherwise(F.coalesce(truthy(told), F.concat(name, F.lit(" is an organisation with a public web presence."))))


def chunks(c: Column, size: int = 3000) -> Column:
    """array of struct(chunk_index, chunk)."""
    n = F.greatest(F.ceil(F.length(c) / size).cast("int"), F.lit(1))
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("chunk_index"), F.substring(c, i * size + 1, F.lit(size)).alias("chunk"))))


def clamp(x: Column, lo, hi) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), x))


def pages(total: Column, limit: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / limit)).cast("int")


def percent(x: Column, total: Column, places: int = 1) -> Column:
    return F.round(x / F.greatest(F.lit(1), total) * 100, places)


def percent_text(v: Column) -> Column:
    return F.when(F.coalesce(v, F.lit(0.0)) == 0, "N/A").otherwise(F.concat(F.format_number(v * 100, 0), F.lit("%")))


def number(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("int")


def digits(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, "[^0-9]", "").try_cast("int"), F.lit(0))


def key_of(*parts: Column) -> Column:
    """md5 of trimmed lower-case parts."""
    return F.md5(F.concat_ws(":", *[F.lower(F.trim(p)) for p in parts]))


def elapsed_ms(start: Column, end: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.round(F.greatest(F.lit(0.0), (micros(end) - micros(start)) / 1000.0), 1)


def fresh(status: Column, updated: Column, verified: Column, as_of, ttl_days: int = 7) -> Column:
    """Whether a verified session is younger than the time to live, at as_of."""
    at = F.coalesce(updated, verified)
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(at.cast("timestamp"))
    return F.coalesce(status.isin("VERIFIED", "POSTGRES_VERIFIED") & (age < ttl_days * 86_400_000_000), F.lit(False))


def ordered_union(a: Column, b: Column) -> Column:
    return F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def sorted_set(a: Column) -> Column:
    return F.array_sort(F.array_distinct(a))


def remaining(all_: Column, done: Column, limit: int, default: Column) -> Column:
    left = F.slice(F.array_except(all_, done), 1, limit)
    return F.when(F.size(left) > 0, left).otherwise(default)


def all_types_seen(required: Column, seen: Column) -> Column:
    return F.forall(required, lambda r: F.exists(seen, lambda s: F.contains(s, r)))


def label(code: Column, table: dict[str, str], default: str | None = None) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, code), F.lit(default))


def last_by_key(entries: Column) -> Column:
    """A map from an array of struct(key, value) where the last of equal keys wins."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))


def merge_maps(old: Column, new: Column) -> Column:
    """Shallow merge, new values win."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(old), lambda e: ~F.map_contains_key(new, e["key"])), F.map_entries(new)))
