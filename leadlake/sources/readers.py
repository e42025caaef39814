"""Where rows come from: tables, documents, JSON-Schema files, search hits in tiers, generated hits and queries."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from leadlake.functions import text as X
from leadlake.functions import url as U

#: Top-level domains looked for in free queries.
QUERY_TLDS = ["com", "io", "ai", "co", "net", "org", "de", "app", "dev"]


def table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """A Parquet table with its filter and columns pushed to the scan."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def catalog_probe(spark: SparkSession) -> DataFrame:
    """Tables and views of the session."""
    rows = [(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, type string, temporary boolean")


def probe_document(spark: SparkSession, path: str, kind: str) -> dict:
    """Shape of a document: columns, rows and a sample of a CSV; lines and preview of a text; length and keys of a JSON list."""
    if kind == "csv":
        df = spark.read.option("header", True).csv(path)
        return {"type": "csv", "columns": df.columns, "row_count": df.count(), "sample": [r.asDict() for r in df.limit(5).collect()]}
    if kind == "json":
        df = spark.read.option("multiLine", True).json(path)
        return {"type": "json", "columns": sorted(df.columns), "row_count": df.count()}
    whole = spark.read.text(path, wholetext=True).select(F.substring("value", 1, 500).alias("p"), (F.size(F.split("value", "\n"))).alias("n")).first()
    return {"type": "text", "preview": whole["p"], "line_count": whole["n"]}


def search_results(raw: DataFrame, limit: int = 10, categories: list[str] | None = None) -> DataFrame:
    """Hits (query, rank, title, url, snippet, engine, score): those with an address, with defaults, the first of each query."""
    r = raw.where(X.truthy(F.col("url")).isNotNull())
    r = r.where(F.col("category").isin(categories)) if categories and "category" in raw.columns else r
    r = r.withColumn("title", F.coalesce(X.truthy(F.col("title")), F.lit("B2B Organization"))).withColumn("score", F.coalesce("score", F.lit(1.0)))
    return r.withColumn("_n", F.row_number().over(W.partitionBy("query").orderBy("rank", "url"))).where(F.col("_n") <= limit).drop("_n")


def first_tier(*tiers: DataFrame) -> DataFrame:
    """For each query the hits of the first tier that has any."""
    all_ = None
    for n, t in enumerate(tiers):
        t = t.withColumn("tier", F.lit(n))
        all_ = t if all_ is None else all_.unionByName(t)
    best = all_.groupBy("query").agg(F.min("tier").alias("_best"))
    return all_.join(best, "query").where("tier = _best").drop("_best")


def direct_entities(queries: DataFrame) -> DataFrame:
    """A hit for each domain that stands in a query itself."""
    found = F.regexp_extract_all(F.lower("query"), F.lit(rf"\b[a-z0-9][a-z0-9\-]*\.(?:{'|'.join(QUERY_TLDS)})\b"), F.lit(0))
    d = queries.select("query", F.explode(F.array_distinct(found)).alias("domain"))
    return d.select("query", F.lit(1).alias("rank"), U.brand(F.col("domain")).alias("title"), F.concat(F.lit("https://"), F.col("domain")).alias("url"), F.lit("").alias("snippet"), F.lit("direct").alias("engine"), F.lit(1.0).alias("score"))


def profile_hits(queries: DataFrame) -> DataFrame:
    """A company profile address from the quoted brand of a query, else from its first word."""
    quoted = F.regexp_extract("query", '"([^"]+)"', 1)
    brand = F.coalesce(X.truthy(quoted), F.regexp_extract("query", r"([A-Za-z0-9&.\-]+)", 1))
    slug = F.regexp_replace(F.regexp_replace(F.lower(brand), r"[^a-z0-9]+", "-"), "^-+|-+$", "")
    return queries.where(slug != "").select("query", F.lit(1).alias("rank"), brand.alias("title"), F.concat(F.lit("https://www.linkedin.com/company/"), slug).alias("url"), F.lit("").alias("snippet"), F.lit("profile").alias("engine"), F.lit(1.0).alias("score"))


def people_queries(companies: DataFrame, templates: list[tuple[str, str, int]]) -> DataFrame:
    """companies (name, domain) times query templates (text with {domain} or {brand}, group, priority); none without a domain or telling brand."""
    brand = F.coalesce(X.truthy(F.col("name")), U.brand(F.col("domain")))
    all_ = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(g).alias("query_group"), F.lit(p).alias("priority")) for t, g, p in templates])
    c = companies.withColumn("_b", brand).where((F.coalesce("domain", F.lit("")) != "") | ~F.lower("_b").isin(X.GENERIC_TITLES + ["company"]))
    q = c.select("name", "domain", "_b", F.explode(all_).alias("x")).select("*", "x.*")
    text = F.replace(F.replace(F.col("t"), F.lit("{domain}"), F.coalesce("domain", F.lit(""))), F.lit("{brand}"), F.col("_b"))
    return q.select("name", "domain", X.sanitize_query(text).alias("query"), "query_group", "priority").where("query is not null")


def discovery_queries(taxonomy: DataFrame, places: list[str], intents: list[str], seed: int = 0) -> DataFrame:
    """taxonomy (domain, subdomain, keyword) with a query each; place and intent follow from a seeded hash, so runs agree."""
    pick = lambda xs, salt: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64("domain", "subdomain", "keyword", F.lit(seed), F.lit(salt)), F.lit(len(xs))) + 1).cast("int"))
    q = F.array_join(F.filter(F.array(F.col("keyword"), pick(intents, 1), pick(places, 2)), lambda w: w != ""), " ")
    return taxonomy.withColumn("query", q)


#: Templates of searches for listings, and for what is like an entity.
LISTING_TEMPLATES = ["list of emerging {keyword} startups", "top {keyword} startups {geo}", "early stage {keyword} companies {geo}", "{keyword} startups official website", "promising {keyword} startups {years}", "{keyword} innovation startups {geo}"]
EXPANSION_TEMPLATES = ["{name} competitors", "companies like {name}", "{name} alternatives", "{domain} companies similar to {name}", "{name} industry peers"]


def templated(rows: DataFrame, templates: list[str], **values: Column) -> DataFrame:
    """rows times the templates: place and query, {name} in a template replaced by the value of that name."""
    out = rows.select("*", F.posexplode(F.array(*map(F.lit, templates))).alias("place", "_t"))
    text = F.col("_t")
    for k, v in values.items():
        text = F.replace(text, F.lit("{" + k + "}"), F.coalesce(v, F.lit("")))
    return out.withColumn("query", F.trim(text)).drop("_t")


def schema_of(doc: dict) -> T.StructType:
    """A JSON-Schema object as a Spark schema: arrays of texts, numbers and truth values keep their type, mixed types are text."""
    simple = {"integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}

    def kind(p: dict) -> T.DataType:
        t = p.get("type", "string")
        t = [x for x in (t if isinstance(t, list) else [t]) if x != "null"]
        if t == ["array"]:
            return T.ArrayType(kind(p.get("items", {})))
        if t == ["object"]:
            return schema_of(p) if p.get("properties") else T.MapType(T.StringType(), T.StringType())
        return simple.get(t[0], T.StringType()) if len(t) == 1 else T.StringType()

    return T.StructType([T.StructField(k, kind(v), True) for k, v in doc.get("properties", {}).items()])


class SchemaRegistry:
    """Schemas by lower-case domain, loaded from texts of JSON files or registered at run time."""

    def __init__(self):
        self.schemas: dict[str, dict] = {}

    def load(self, spark: SparkSession, folder: str) -> SchemaRegistry:
        for r in spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").toLocalIterator():
            doc = json.loads(r.value)
            if doc.get("domain"):
                self.schemas[doc["domain"].lower()] = doc
        return self

    def register(self, domain: str, properties: dict, version: str = "1.0.0") -> dict:
        doc = {"domain": domain.title(), "version": version, "properties": properties}
        self.schemas[domain.lower()] = doc
        return doc

    def names(self) -> list[str]:
        return sorted(self.schemas)

    def get(self, domain: str) -> T.StructType | None:
        doc = self.schemas.get(domain.lower())
        return schema_of(doc) if doc else None


def enforce(json_text: Column, schema: T.StructType) -> Column:
    """Declared fields only; missing is null, or an empty list for lists; a single value for a list becomes a list of it."""
    lists = [f.name for f in schema if isinstance(f.dataType, T.ArrayType)]
    got = F.from_json(json_text, schema)
    raw = F.from_json(json_text, T.MapType(T.StringType(), T.StringType()))
    single = lambda n: F.when(~F.startswith(F.try_element_at(raw, F.lit(n)), F.lit("[")), F.array(F.try_element_at(raw, F.lit(n))))
    return F.struct(*[(F.coalesce(got[f.name], single(f.name).cast(f.dataType), F.array().cast(f.dataType)) if f.name in lists else got[f.name]).alias(f.name) for f in schema])


def reply(text: Column) -> Column:
    """A map from a reply in a code fence, without empty values."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.map_filter(F.from_json(bare, "map<string,string>"), lambda k, v: F.coalesce(v, F.lit("")) != "")
