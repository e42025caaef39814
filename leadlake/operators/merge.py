"""Upserts as joins: a rule for each column says what becomes of the old and the new value. Over Parquet a merge is a rewritten snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlake.functions import text as X
from leadlake.functions import url as U

#: name -> (old, new, matched) -> value
RULES = {
    "overwrite": lambda o, n, m: F.when(m, n).otherwise(o),
    "overwrite_even_null": lambda o, n, m: F.when(m, n).otherwise(o),
    "keep_if_null": lambda o, n, m: F.coalesce(n, o),
    "truthy_wins": lambda o, n, m: F.coalesce(X.truthy(n.cast("string")).cast("string"), o.cast("string")),
    "fill": lambda o, n, m: F.coalesce(o, n),
    "map_merge": lambda o, n, m: F.when(o.isNull(), n).when(n.isNull(), o).otherwise(X.merge_maps(o, n)),
}


def merge(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """old with new merged in on keys. Columns without a rule are overwritten; defaults hold for inserted rows where the value is missing.
    new has one row for each key (see relational.latest_by)."""
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    matched, inserted = F.coalesce(*[F.col(f"n.{k}").isNotNull() for k in keys]), F.col(f"o.{keys[0]}").isNull()
    out = []
    for c in old.columns:
        kind = old.schema[c].dataType
        if c in keys:
            v = F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))
        elif c not in new.columns:
            v = F.col(f"o.{c}")
        else:
            v = RULES[rules.get(c, "overwrite")](F.col(f"o.{c}"), F.col(f"n.{c}"), matched)
            v = v if isinstance(kind, T.MapType) else v.cast(kind)
        if defaults and c in defaults:
            v = F.when(inserted, F.coalesce(v, defaults[c].cast(kind))).otherwise(v)
        out.append(v.alias(c))
    return j.select(*out)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the rows of new whose keys it lacks."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """By url, every column replaced."""
    return merge(old, new, ["url"], {})


def upsert_companies(old: DataFrame, new: DataFrame) -> DataFrame:
    """By primary_domain: description, country and confidence only where the new value says something; new rows get a name, an industry and a status."""
    rules = {c: "fill" for c in old.columns} | {"description": "truthy_wins", "country": "truthy_wins", "confidence": "keep_if_null"}
    name = F.coalesce(F.col("n.canonical_name"), F.col("n.primary_domain"), F.lit("Unknown"))
    return merge(old, new, ["primary_domain"], rules, {"canonical_name": name, "status": F.lit("DISCOVERED")})


def upsert_leads(old: DataFrame, new: DataFrame) -> DataFrame:
    """By md5 of the domain; logo and profile only where the new value says something, all else replaced even by null."""
    keyed = new.withColumn("id", X.key_of(F.col("domain")))
    return merge(old, keyed, ["id"], {"logo_url": "truthy_wins", "linkedin_url": "truthy_wins"})


def person_id(domain: Column, name: Column, separator: str = ":") -> Column:
    return F.md5(F.concat_ws(separator, F.lower(F.trim(domain)), F.lower(F.trim(name))))


def upsert_metadata(old: DataFrame, new: DataFrame) -> DataFrame:
    """By (entity_type, entity_key): null keeps the old value, extra merges shallowly, the new value of a key wins."""
    rules = {c: "keep_if_null" for c in old.columns} | {"extra": "map_merge"}
    return merge(old, new, ["entity_type", "entity_key"], rules)


def soft_delete(old: DataFrame, gone: DataFrame) -> DataFrame:
    g = gone.select("entity_type", "entity_key").distinct().withColumn("_gone", F.lit(True))
    return old.join(g, ["entity_type", "entity_key"], "left").withColumn("is_present", F.when(F.col("_gone"), False).otherwise(F.col("is_present"))).select(*old.columns)


def replace_session(old: DataFrame, new: DataFrame, session: str = "session_id") -> DataFrame:
    """Rows of the sessions in new are replaced as a whole."""
    return old.join(new.select(session).distinct(), session, "left_anti").unionByName(new.select(*old.columns))


def rediscover_people(old: DataFrame, new: DataFrame) -> DataFrame:
    """People met again: a missing source is filled and makes them HIGH_CONFIDENCE; others are added."""
    n = new.groupBy("company_id", F.lower("full_name").alias("_k")).agg(F.min("source_url").alias("_url"))
    o = old.withColumn("_k", F.lower("full_name")).join(n, ["company_id", "_k"], "left")
    fills = F.col("source_url").isNull() & F.col("_url").isNotNull()
    kept = o.withColumn("verification_status", F.when(fills, "HIGH_CONFIDENCE").otherwise(F.col("verification_status"))).withColumn("source_url", F.coalesce("source_url", "_url")).select(*old.columns)
    from leadlake.operators.relational import new_names

    return new_names(kept, new, ["company_id"], "full_name")


def promote(companies: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Companies take the state of their contract; a verified one that fails is downgraded, not removed."""
    v = verdicts.select("company_id", F.col("state").alias("_state"), F.col("confidence").alias("_c"))
    j = companies.join(v, companies.id == v.company_id, "left")
    status = F.when(F.col("_state") == "VERIFIED", "VERIFIED").when(F.col("_state").isNotNull() & (F.col("status") == "VERIFIED"), "NEEDS_REVIEW").when(F.col("_state").isNotNull(), F.col("_state")).otherwise(F.col("status"))
    return j.withColumn("status", status).withColumn("confidence", F.coalesce("_c", "confidence")).select(*companies.columns)


def outbox_enqueue(outbox: DataFrame, leads: DataFrame) -> DataFrame:
    """A row for each clean domain; a row that is there is armed again."""
    n = leads.select(U.canonical_domain(F.col("domain")).alias("domain"), "payload").groupBy("domain").agg(F.max("payload").alias("payload")).withColumn("sync_status", F.lit("PENDING_SYNC")).withColumn("retry_count", F.lit(0))
    return merge(outbox, n, ["domain"], {})


def outbox_step(outbox: DataFrame, results: DataFrame, limit: int = 20, max_retries: int = 5) -> DataFrame:
    """The oldest pending rows take the outcome of their try (results: id, ok): COMPLETED, or RETRY until the tries are used up, then FAILED."""
    due = outbox.where(F.col("status").isin("PENDING", "RETRY") & (F.col("retry_count") < max_retries)).orderBy("created_at", "id").limit(limit).select("id")
    j = outbox.join(due.join(results, "id"), "id", "left")
    tries = F.col("retry_count") + 1
    status = F.when(F.col("ok"), "COMPLETED").when(~F.col("ok"), F.when(tries < max_retries, "RETRY").otherwise("FAILED")).otherwise(F.col("status"))
    return j.withColumn("_tries", F.when(~F.col("ok"), tries).otherwise(F.col("retry_count"))).withColumn("status", status).withColumn("retry_count", F.col("_tries")).select(*outbox.columns)


def outbox_summary(outbox: DataFrame) -> DataFrame:
    return outbox.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def recover(fallback: DataFrame, primary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows held back while the primary was away: merged by id, else by host; and a row that tells whether the mode may flip (none pending)."""
    f = fallback.withColumn("_host", U.host(F.col("url")))
    by_id = f.join(primary.select("id"), "id", "left_semi").withColumn("matched", F.lit("id"))
    rest = f.join(primary.select("id"), "id", "left_anti")
    hosts = primary.select(U.host(F.col("url")).alias("_host")).distinct().withColumn("_hit", F.lit("host"))
    other = rest.join(hosts, "_host", "left").withColumn("matched", F.coalesce("_hit", F.lit("new"))).drop("_hit")
    out = by_id.unionByName(other.select(*by_id.columns)).drop("_host")
    return out, fallback.agg((F.count_if(F.col("status") == "PENDING_SYNC") == 0).alias("may_flip"))


def block(blocked: DataFrame, hosts: DataFrame) -> DataFrame:
    """Adds hosts (url, reason_category, source) whose domain and root are not listed yet."""
    h = hosts.select(U.safety_domain(F.col("url")).alias("domain"), U.root_domain(F.col("url")).alias("_root"), "reason_category", "source").where("domain <> ''").dropDuplicates(["domain"])
    known = blocked.select(F.col("domain").alias("_d"))
    new = h.join(known, h.domain == F.col("_d"), "left_anti").join(known, F.col("_root") == F.col("_d"), "left_anti").drop("_root")
    return blocked.unionByName(new.select(*blocked.columns))


def unblock(blocked: DataFrame, hosts: DataFrame) -> DataFrame:
    return blocked.join(hosts.select(U.safety_domain(F.col("url")).alias("domain")).distinct(), "domain", "left_anti")


def review(queue: DataFrame, decisions: DataFrame, blocked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions (id, approve) close queue rows; a rejected row's domain is blocked."""
    j = queue.join(decisions, "id", "left")
    done = j.withColumn("status", F.when(F.col("approve"), "APPROVED").when(~F.col("approve"), "REJECTED").otherwise(F.col("status"))).select(*queue.columns)
    bad = j.where(~F.col("approve")).select(F.col("domain").alias("url"), F.lit("manual_review").alias("reason_category"), F.lit("manual_review").alias("source"))
    return done, block(blocked, bad)
