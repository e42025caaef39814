"""Field investigations: ladders of strategies over all sessions at once. Each strategy works on what the ones before it left open."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions import text as X
from leadlake.functions import url as U
from leadlake.operators import filters as R
from leadlake.operators.relational import first_of
from leadlake.session import kept

#: Hits whose pages are fetched, hosts whose pages are not.
FETCHED, UNFETCHED = 3, ["linkedin.com", "crunchbase.com"]

#: The methods by strategy.
METHODS = {1: "crawled_text", 2: "targeted_subpage_evidence", 3: "search_snippet_extraction", 4: "scraped_page_extraction"}


class Field(NamedTuple):
    """How a field is looked for: extract gives a string, or null where the text says nothing; relaxed is asked of the own text a second time and
    credited to the page at `path`; the kinds of sources that own text, that page and the search count as."""

    name: str
    extract: Callable[[Column], Column]
    path: str
    kinds: tuple[str, str, str]
    relaxed: Callable[[Column], Column] | None = None


def _value(fields: list[Field], text: Column) -> Column:
    """The value of the row's own field; one extractor runs on a row."""
    return reduce(lambda c, f: c.when(F.col("field") == f.name, X.truthy(f.extract(text))), fields, F.when(F.lit(False), F.lit(None).cast("string")))


def investigate(sessions: DataFrame, hits: DataFrame, pages: DataFrame, fields: list[Field]) -> DataFrame:
    """A row for each session (session_id, domain, text, search_failed) and field: strategy, value, source_url, snippet, method, status, reason.

    1: the own text; 2: the own text, asked less strictly, credited to a page of the site; 3: title and snippet of the session's search hits
    (session_id, rank, url, title, snippet), best link first; 4: the pages (url, text) of the three best of these, few hosts excepted. What is left is
    NOT_FOUND_AFTER_SEARCH if enough was looked at, else UNVERIFIED; a search that failed leaves the session's fields UNVERIFIED.

    Nulls are texts that say nothing; of repeated sessions or hits one row counts. A session's texts are read once for all fields; hits and pages are
    joined to open fields alone. Each strategy's finds are a written table, so none is worked out twice."""
    own = F.col("text")
    site = F.concat(F.lit("https://"), F.col("domain"))
    tried = F.array(*[F.struct(F.lit(f.name).alias("field"), X.truthy(f.extract(own)).alias("v1"), X.truthy((f.relaxed or f.extract)(own)).alias("v2"), F.lit(f.path).alias("path")) for f in fields])
    base = sessions.dropDuplicates(["session_id"]).select("session_id", site.alias("site"), F.coalesce("search_failed", F.lit(False)).alias("failed"), F.explode(tried).alias("t")).select("session_id", "site", "failed", "t.*")
    base = kept(base, "fields-own")
    found = [base.where("coalesce(v1, v2) is not null").select(
        "session_id", "field", F.when(F.col("v1").isNotNull(), 1).otherwise(2).alias("strategy"), F.coalesce("v1", "v2").alias("value"),
        F.when(F.col("v1").isNotNull(), F.col("site")).otherwise(F.concat("site", "path")).alias("source_url"), F.coalesce("v1", "v2").alias("snippet"),
    )]
    open_ = base.where("v1 is null and v2 is null and not failed").select("session_id", "field")

    some = hits.where(F.startswith("url", F.lit("http"))).groupBy("session_id", "url").agg(F.min_by(F.struct("rank", "title", "snippet"), F.struct("rank", "title", "snippet")).alias("h"))
    place = F.struct(U.link_score(F.col("url"), F.col("url")).alias("score"), F.col("h.rank").alias("rank"), F.col("url").alias("url")).alias("place")
    seen = some.select("session_id", place, F.trim(F.concat_ws(" ", F.coalesce("h.title", F.lit("")), F.coalesce("h.snippet", F.lit("")))).alias("said"))

    def best(rows: DataFrame, text: str, strategy: int) -> DataFrame:
        got = rows.withColumn("value", _value(fields, F.col(text))).where("value is not null")
        first = got.groupBy("session_id", "field").agg(F.min_by(F.struct("place.url", "value", F.substring(text, 1, 200).alias("snippet")), F.struct("place", "value")).alias("b"))
        return kept(first.select("session_id", "field", F.lit(strategy).alias("strategy"), F.col("b.value").alias("value"), F.col("b.url").alias("source_url"), F.col("b.snippet").alias("snippet")), f"fields-{strategy}")

    found.append(best(open_.join(seen, "session_id"), "said", 3))
    open_ = open_.join(found[-1], ["session_id", "field"], "left_anti")
    top = first_of(seen.join(open_.select("session_id").distinct(), "session_id", "left_semi"), ["session_id"], ["place"], FETCHED)
    fetched = top.where(~F.col("place.url").rlike(U.quoted(UNFETCHED))).join(pages.select(F.col("url").alias("_u"), F.col("text").alias("page")), F.col("place.url") == F.col("_u"))
    found.append(best(open_.join(fetched, "session_id"), "page", 4))

    all_ = reduce(lambda a, b: a.unionByName(b), found)
    out = base.select("session_id", "field", "failed").join(all_, ["session_id", "field"], "left")
    kinds = F.create_map(*[y for f in fields for y in (F.lit(f.name), F.array(*[F.lit(k) for k in (*f.kinds, "secondary_search")]))])
    record = F.struct(
        F.when(F.col("failed"), "SEARCH_UNAVAILABLE").alias("infra_failure"), F.try_element_at(kinds, F.col("field")).alias("sources_checked"), F.lit(1).alias("search_attempts"),
        F.lit(True).alias("strategies_exhausted"), F.col("value").isNotNull().alias("evidence_found"),
    )
    verdict = R.can_mark_not_found(F.col("field"), record)
    method = F.coalesce(F.try_element_at(F.create_map(*[F.lit(y) for kv in METHODS.items() for y in kv]), F.col("strategy")), F.lit("exhausted_investigation"))
    status = F.when(F.col("value").isNotNull(), "VERIFIED").when(verdict["keep"], "NOT_FOUND_AFTER_SEARCH").otherwise("UNVERIFIED")
    return out.select("session_id", "field", "strategy", "value", "source_url", "snippet", method.alias("method"), status.alias("status"), F.when(F.col("value").isNull(), verdict["reason"]).alias("reason"))
