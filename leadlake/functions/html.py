"""Page facts from HTML by regular expressions; the recursive walk of JSON-LD is the one Arrow function here."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlake.functions import text as X
from leadlake.functions import url as U

#: Endings of file names that look like addresses.
NOT_MAIL = [".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".bmp", ".ico", ".tif", ".tiff", ".avif", ".mp4", ".mov", ".pdf", ".css", ".js"]
#: Mail hosts that are never a company's.
JUNK_MAIL = ["example.com", "domain.com", "wixpress", "sentry", "github.com"]
#: Hosts that a listing links to without listing them, and paths of profiles on the listing's own host.
NOT_LISTED = ["linkedin.com", "twitter.com", "x.com", "facebook.com", "instagram.com", "youtube.com", "github.com", "google.com", "wikipedia.org", "medium.com", "reddit.com", "amazon.com", "apple.com", "microsoft.com", "cloudflare.com"]
PROFILE_PATHS = ["/company/", "/organization/", "/startup/", "/profile/", "/c/", "/co/", "/vendor/", "/product/", "/app/"]
SCRIPTS = ("script", "style")
NOISE = ("script", "style", "noscript", "svg", "head", "title", "meta")
CHROME = ("script", "style", "noscript", "svg", "header", "footer", "nav")

MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_QUOTED = r"""["']([^"']*)["']"""


def _found(c: Column) -> Column:
    return X.truthy(F.trim(c))


def tag_text(html: Column, tag: str) -> Column:
    inner = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    return _found(X.collapse(F.regexp_replace(inner, "<[^>]*>", " ")))


def meta(html: Column, key: str, attribute: str = "name") -> Column:
    """content of a meta tag, whichever attribute comes first."""
    k = U.quoted([key])
    a = F.regexp_extract(html, rf"""(?is)<meta\b[^>]*?\b{attribute}\s*=\s*["']{k}["'][^>]*?\bcontent\s*=\s*{_QUOTED}""", 1)
    b = F.regexp_extract(html, rf"""(?is)<meta\b[^>]*?\bcontent\s*=\s*{_QUOTED}[^>]*?\b{attribute}\s*=\s*["']{k}["']""", 1)
    return F.coalesce(_found(a), _found(b))


def title(html: Column) -> Column:
    return F.coalesce(X.normalize_string(meta(html, "og:title", "property")), X.normalize_string(tag_text(html, "title")), X.normalize_string(tag_text(html, "h1")))


def description(html: Column) -> Column:
    d = F.coalesce(meta(html, "description"), meta(html, "og:description", "property"))
    return F.when(F.length(d) > 5, d)


def canonical(html: Column, url: Column) -> Column:
    a = F.regexp_extract(html, rf"""(?is)<link\b[^>]*?\brel\s*=\s*["']canonical["'][^>]*?\bhref\s*=\s*{_QUOTED}""", 1)
    b = F.regexp_extract(html, rf"""(?is)<link\b[^>]*?\bhref\s*=\s*{_QUOTED}[^>]*?\brel\s*=\s*["']canonical["']""", 1)
    found = F.coalesce(_found(a), _found(b))
    return F.coalesce(F.when(found.isNotNull(), U.normalize(found, url)), url)


def language(html: Column) -> Column:
    return X.normalize_language(F.regexp_extract(html, rf"(?is)<html\b[^>]*?\blang\s*=\s*{_QUOTED}", 1))


def without(html: Column, tags: tuple[str, ...] = SCRIPTS) -> Column:
    """Elements of these tags taken out, one pattern for each tag."""
    return reduce(lambda c, t: F.regexp_replace(c, rf"(?is)<{t}\b.*?</{t}\s*>", " "), tags, html)


def clean_text(html: Column, tags: tuple[str, ...] = NOISE) -> Column:
    """Visible text: elements of tags and comments go, other tags become spaces, entities are decoded, white space collapses."""
    bare = F.regexp_replace(F.regexp_replace(without(html, tags), r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    return X.collapse(X.unescape(bare))


def head_text(html: Column) -> Column:
    """The text of a page's first 15000 characters."""
    return X.collapse(F.regexp_replace(without(F.substring(html, 1, 15000)), "<[^>]*>", " "))


def preview(html: Column) -> Column:
    return F.substring(head_text(html), 1, 3500)


def links(html: Column) -> Column:
    """array of struct(href, text) of anchors."""
    rx = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>"""
    hrefs, texts = F.regexp_extract_all(html, F.lit(rx), F.lit(1)), F.regexp_extract_all(html, F.lit(rx), F.lit(2))
    return F.transform(F.arrays_zip(hrefs.alias("h"), texts.alias("t")), lambda x: F.struct(F.trim(x["h"]).alias("href"), X.collapse(F.regexp_replace(x["t"], "<[^>]*>", " ")).alias("text")))


def media(html: Column) -> Column:
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))
    return F.transform(tags, lambda t: F.struct(F.regexp_extract(t, rf"(?is)\bsrc\s*=\s*{_QUOTED}", 1).alias("src"), F.regexp_extract(t, rf"(?is)\balt\s*=\s*{_QUOTED}", 1).alias("alt")))


def logo(html: Column, url: Column) -> Column:
    icon = F.regexp_extract(html, rf"""(?is)<link\b[^>]*?\brel\s*=\s*["'][^"']*icon[^"']*["'][^>]*?\bhref\s*=\s*{_QUOTED}""", 1)
    image = F.regexp_extract(html, rf"""(?is)<img\b(?=[^>]*\b(?:alt|class|id)\s*=\s*["'][^"']*logo)[^>]*?\bsrc\s*=\s*{_QUOTED}""", 1)
    found = F.coalesce(_found(icon), meta(html, "og:image", "property"), _found(image))
    return F.when(found.isNotNull(), U.resolve(found, url))


def mailtos(html: Column) -> Column:
    hrefs = F.filter(F.transform(links(html), lambda x: x["href"]), lambda h: F.lower(h).startswith("mailto:"))
    return F.transform(hrefs, lambda h: F.lower(F.trim(F.regexp_replace(F.substring_index(h, "?", 1), "(?i)^mailto:", ""))))


def contact_mails(html: Column, more: Column | None = None) -> Column:
    """Mail links, then addresses found elsewhere, that are well formed and not junk: the first five, each once."""
    all_ = mailtos(html) if more is None else F.concat(mailtos(html), F.transform(more, lambda e: F.lower(F.trim(e))))
    good = F.filter(all_, lambda e: e.rlike(rf"^{MAIL}$") & ~e.rlike(U.quoted(JUNK_MAIL)))
    return F.slice(F.array_distinct(good), 1, 5)


def page_mails(text: Column, html: Column) -> Column:
    """Addresses in mail links, text and source, without names of files; sorted."""
    both = F.concat_ws(" ", text, html)
    found = F.transform(F.regexp_extract_all(both, F.lit(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z|]{2,7}\b"), F.lit(0)), F.lower)
    files = rf"(?:{U.quoted(NOT_MAIL)})$"
    found = F.filter(found, lambda e: ~e.rlike(files))
    return X.sorted_set(F.filter(F.concat(F.coalesce(mailtos(html), F.array().cast("array<string>")), found), lambda e: e.rlike(r"@[^@]*\.[^@]*$") & (F.length(F.substring_index(e, "@", -1)) >= 4)))


def socials(html: Column) -> Column:
    """array of struct(type, url), each address once, in order."""
    hrefs = F.array_distinct(F.transform(links(html), lambda x: x["href"]))
    low = lambda h: F.lower(h)
    kind = lambda h: (
        F.when(F.contains(low(h), F.lit("linkedin.com/company/")), "linkedin_company")
        .when(low(h).rlike(r"twitter\.com/|x\.com/"), F.when(~low(h).rlike("/share|/intent|/widgets"), "twitter"))
        .when(F.contains(low(h), F.lit("github.com/")), "github")
    )
    return F.filter(F.transform(hrefs, lambda h: F.struct(kind(h).alias("type"), h.alias("url"))), lambda s: s["type"].isNotNull())


def listed(html: Column, url: Column, limit: int = 50) -> Column:
    """Addresses of the entities that a listing page links to: other hosts but the usual ones, and profiles on its own host."""
    base = U.authority(url)
    hrefs = F.filter(F.transform(links(html), lambda x: x["href"]), lambda h: h.rlike(r"^(https?:|/)"))
    full = F.transform(hrefs, lambda h: F.when(h.startswith("//"), F.concat(F.lit("https:"), h)).when(h.startswith("/"), F.concat(U.site_root(url), h)).otherwise(h))
    own = lambda h: (U.authority(h) == base) & F.lower(U.path(h)).rlike(U.quoted(PROFILE_PATHS))
    other = lambda h: (U.authority(h) != base) & ~U.authority(h).rlike(U.quoted(NOT_LISTED))
    return F.slice(F.array_distinct(F.filter(full, lambda h: own(h) | other(h))), 1, limit)


def geo(html: Column) -> Column:
    place = F.coalesce(meta(html, "geo.placename"), meta(html, "business:contact_data:locality", "property"))
    land = F.coalesce(meta(html, "country"), meta(html, "og:country-name", "property"), meta(html, "business:contact_data:country_name", "property"))
    return F.struct(meta(html, "geo.region").alias("region"), place.alias("placename"), land.alias("country"))


JSON_LD = "struct<type:string,mails:array<string>,city:string,region:string,country:string,street:string,postal_code:string,formatted:string,employees:string>"


def json_ld():
    """Arrow function: html -> the facts of its JSON-LD blocks, depth first; the first type, address and head count that say something win."""
    from pyspark.sql.pandas.functions import PandasUDFType

    @F.pandas_udf(JSON_LD, PandasUDFType.SCALAR)
    def run(pages):
        import json
        import re

        import pandas as pd

        block = re.compile(r"""<script\b[^>]*\btype\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script\s*>""", re.I | re.S).findall
        plain = {"webpage", "website", "breadcrumblist"}

        def nodes(x):
            if isinstance(x, list):
                for y in x:
                    yield from nodes(y)
            elif isinstance(x, dict):
                if isinstance(x.get("@graph"), list):
                    yield from nodes(x["@graph"])
                else:
                    yield x

        def address(a):
            if isinstance(a, str):
                return {"formatted": a.strip()} if len(a.strip()) > 3 else {}
            if not isinstance(a, dict):
                return {}
            land = a.get("addressCountry")
            land = land.get("name") if isinstance(land, dict) else land
            return {"city": a.get("addressLocality"), "region": a.get("addressRegion"), "country": land, "street": a.get("streetAddress"), "postal_code": a.get("postalCode")}

        def staff(e):
            if isinstance(e, dict):
                e = e.get("value") or e.get("minValue")
            return None if e in (None, "") or isinstance(e, (list, bool)) else str(int(e)) if isinstance(e, (int, float)) else str(e).strip()

        def facts(html):
            out = dict.fromkeys(["type", "mails", "city", "region", "country", "street", "postal_code", "formatted", "employees"])
            out["mails"] = []
            for body in block(html or ""):
                try:
                    found = list(nodes(json.loads(body.strip())))
                except ValueError:
                    continue
                for n in found:
                    kinds = n.get("@type")
                    kinds = [k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str) and k.lower() not in plain]
                    out["type"] = out["type"] or next(iter(kinds), None)
                    if isinstance(n.get("email"), str):
                        out["mails"].append(n["email"].replace("mailto:", "").strip())
                    if not any(out[k] for k in ("city", "region", "country", "formatted")):
                        out |= {k: str(v) for k, v in address(n.get("address")).items() if v}
                    out["employees"] = out["employees"] or staff(n.get("numberOfEmployees"))
            return out

        return pd.DataFrame([facts(p) for p in pages], columns=["type", "mails", "city", "region", "country", "street", "postal_code", "formatted", "employees"])

    return run


def location(ld: Column, html: Column, url: Column) -> Column:
    """struct(city, region, country, formatted): address of the structured data, then geo tags, then the top-level domain."""
    g = geo(html)
    city = F.coalesce(X.truthy(ld["city"]), g["placename"])
    region = F.coalesce(X.truthy(ld["region"]), g["region"])
    land = F.coalesce(X.normalize_country(ld["country"]), X.normalize_country(g["country"]), U.country(url))
    parts = F.array_compact(F.array(city, F.when(~region.eqNullSafe(city), region), land))
    return F.struct(city.alias("city"), region.alias("region"), land.alias("country"), F.coalesce(ld["formatted"], X.truthy(F.array_join(parts, ", "))).alias("formatted"))
