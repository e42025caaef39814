"""Where rows go: content-addressed paths, exports, dead letters. Writes are whole snapshots, committed by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions import text as X
from leadlake.functions import url as U

FOLDERS = {"page": ("raw/pages/", ".html"), "document": ("raw/documents/", ""), "logo": ("raw/logos/", ""), "markdown": ("processed/markdown/", ".md"), "text": ("processed/text/", ".txt")}


def content_path(content: Column, kind: str, ending: Column | None = None) -> Column:
    """Path by the content's sha256, so equal content is stored once."""
    folder, default = FOLDERS[kind]
    return F.concat(F.lit(folder), F.sha2(content.cast("binary"), 256), F.coalesce(ending, F.lit(default)) if ending is not None else F.lit(default))


def store(df: DataFrame, content: str, kind: str, folder: str) -> DataFrame:
    """Contents once each, as a table by path; returns the table written."""
    out = df.select(content_path(F.col(content), kind).alias("path"), F.col(content).alias("content")).dropDuplicates(["path"])
    out.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def artifact(company: Column, page: Column, content: Column) -> Column:
    """struct(path, metadata as JSON) of a company's artifact."""
    path = F.concat_ws("/", F.lit("companies"), U.artifact_slug(company), F.concat(U.artifact_slug(page), F.lit(".html")))
    meta = F.struct(company.alias("company"), page.alias("page"), F.length(content).alias("size"), F.sha2(content.cast("binary"), 256).alias("sha256"))
    return F.struct(path.alias("path"), F.to_json(meta).alias("metadata"))


def dom_path(url: Column) -> Column:
    return F.concat(F.lit("processed/markdown/"), F.substring(F.regexp_replace(F.regexp_replace(url, "^https?://", ""), "[^A-Za-z0-9_-]", "_"), 1, 80), F.lit(".md"))


def existing(wanted: DataFrame, path: str, spark, folder: str, hashed: str | None = None) -> DataFrame:
    """wanted with exists, size, backend, error and is_infra_error of the file at each path below folder, from the listing alone; with hashed, a
    column of content hashes, also hash_matches (the hash stands in the path's name, as content_path puts it).

    A folder that can't be listed is a failure of the store, not of the file: every row then has exists false and is_infra_error true.
    """
    from pyspark.errors import AnalysisException

    root = folder.rstrip("/") + "/"
    backend = F.lit(folder.split("://", 1)[0] if "://" in folder else "local")
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size"))
        error = F.lit(None).cast("string")
    except AnalysisException as e:
        files = spark.createDataFrame([], "path string, size long")
        error = F.lit(f"STORE_UNAVAILABLE: {e.getCondition() or 'listing failed'}")
    bare = lambda c: F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")  # noqa: E731  file:/x, file:///x and /x are one
    below = F.substring(bare(F.col("path")), F.length(bare(F.lit(root))) + 1, F.length("path"))
    found = files.select(below.alias("_below"), "size")
    out = wanted.withColumn("_below", F.ltrim(F.col(path), F.lit("/"))).join(found, "_below", "left").drop("_below")
    out = out.withColumn("exists", F.col("size").isNotNull()).withColumn("backend", backend)
    out = out.withColumn("error", F.coalesce(error, F.when(~F.col("exists"), "NOT_FOUND"))).withColumn("is_infra_error", error.isNotNull())
    return out.withColumn("hash_matches", F.col("exists") & F.contains(F.col(path), F.col(hashed))) if hashed else out


#: The columns of an export, in order.
EXPORT = ["id", "company_name", "domain", "url", "country", "headquarters", "industry", "company_tier", "verified_emails", "decision_makers", "technology_stack", "confidence_score", "summary", "created_at"]


def export(leads: DataFrame) -> DataFrame:
    """Leads newest first, in the 14 columns of EXPORT: arrays joined by ', ', people as 'name (title)' by '; '. Written with .write.csv or .json.

    leads: id, canonical_name, url, country, headquarters, industry, company_tier, verified_emails, people (array of name, title),
    technology_stack, confidence, description, created_at; names that are no entity's are left out.
    """
    from leadlake.operators.filters import filter_entity

    sure = F.coalesce("confidence", F.lit(0.85))
    keep = filter_entity(F.col("canonical_name"), F.coalesce("url", F.lit("")), F.coalesce("confidence", F.lit(0.5)))["keep"]
    person = lambda p: F.concat(F.coalesce(p["name"], F.lit("None")), F.lit(" ("), F.coalesce(p["title"], F.lit("None")), F.lit(")"))
    joined = lambda c: F.coalesce(F.array_join(c, ", "), F.lit(""))
    out = leads.where(keep).orderBy(F.col("created_at").desc_nulls_first(), "id")
    return out.select(
        F.col("id").cast("string").alias("id"), F.col("canonical_name").alias("company_name"), F.replace(U.authority(F.col("url")), F.lit("www."), F.lit("")).alias("domain"), "url",
        F.coalesce(X.truthy(F.col("country")), F.lit("Global")).alias("country"), F.coalesce(X.truthy(F.col("headquarters")), F.lit("Not Specified")).alias("headquarters"),
        F.coalesce(X.truthy(F.col("industry")), F.lit("Commercial Web")).alias("industry"), "company_tier", joined("verified_emails").alias("verified_emails"),
        F.coalesce(F.array_join(F.transform("people", person), "; "), F.lit("")).alias("decision_makers"), joined("technology_stack").alias("technology_stack"),
        sure.cast("double").alias("confidence_score"), F.coalesce("description", F.lit("")).alias("summary"),
        F.coalesce(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("created_at"),
    )


def dead_letter_page(letters: DataFrame, offset: int, limit: int) -> DataFrame:
    return letters.orderBy(F.col("failed_at").desc(), "id").offset(offset).limit(limit)


def empty_like(df: DataFrame) -> DataFrame:
    """The table's reset: its schema without rows."""
    return df.limit(0)
