"""Joins, picks, pages and ladders over whole tables. Equi-joins first; what only a theta join can find runs on the rest alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leadlake.functions import text as X
from leadlake.functions import url as U
from leadlake.session import kept


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order. An aggregate of structs, so map-side combining leaves one row for each key and task."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_by(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row with the greatest `by` of each key, by a partial aggregation rather than a sort of each key's rows."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns)


def first_of(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key. Tasks keep k rows of each key before the shuffle, so a key with all rows is no burden."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def keep_first(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """One row for each key, the one that stands first."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(position)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns)


def merge_candidates(df: DataFrame, group: list[str], domain: str, source: str, position: str, trusted: str = "postgres") -> DataFrame:
    """One candidate for each root domain: its place is the first's, its value the last trusted one's if there is any, else the first's."""
    d = df.withColumn("_root", U.root_domain(F.col(domain))).where("_root <> ''")
    row = F.struct(*df.columns)
    t = F.col(source) == trusted
    g = d.groupBy(*group, "_root").agg(F.min(position).alias("_place"), F.max_by(row, F.when(t, F.col(position))).alias("_t"), F.min_by(row, F.col(position)).alias("_f"), F.bool_or(t).alias("_any"))
    g = g.withColumn("_v", F.when(F.col("_any"), F.col("_t")).otherwise(F.col("_f")))
    return g.select(*[F.col("_v")[c].alias(c) for c in df.columns if c != position], F.col("_place").alias(position))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def with_page_count(df: DataFrame, limit: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", X.pages(F.col("total"), limit))


def optional(df: DataFrame, **predicates: Column | None) -> DataFrame:
    """Filters that are given; None means no filter."""
    given = [p for p in predicates.values() if p is not None]
    return df.where(reduce(lambda a, b: a & b, given)) if given else df


def contains_any(term: str, *cols: str) -> Column:
    """Case-insensitive containment in any column; % and _ of the user keep their meaning."""
    return reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{term}%") for c in cols])


def tier_filter(tier: str | None, col: str) -> Column | None:
    """None for 'All'; else containment either way."""
    if not tier or tier == "All":
        return None
    return F.contains(F.lower(F.lit(tier)), F.lower(F.col(col))) | F.contains(F.lower(F.col(col)), F.lower(F.lit(tier)))


def either_key(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], row_id: str | list[str]) -> DataFrame:
    """left joined to right on any of the key pairs: one equi-join for each, united, a right row (row_id names it) once for each left row (its first column
    names it). A pair comes from the first key that it shares, so nothing is kept to tell pairs apart. Of rows of one name the least stands for all, with the keys of all."""

    def named(df: DataFrame, by: list[str], keys: list[str], side: str) -> DataFrame:
        cols = [c for c in df.columns if c not in by]
        rest = [F.min(F.struct(*cols)).alias("_rest")] if cols else []
        sets = [F.collect_set(k).alias(f"_{side}{i}") for i, k in enumerate(keys)]
        return df.groupBy(*by).agg(*rest, *sets).select(*by, *(["_rest.*"] if rest else []), *[f"_{side}{i}" for i in range(len(keys))])

    l, r = named(left, left.columns[:1], [a for a, _ in pairs], "l"), named(right, [row_id] if isinstance(row_id, str) else row_id, [b for _, b in pairs], "r")
    hits = []
    for i in range(len(pairs)):
        first = (F.size(f"_l{i}") == 1) | (F.size(f"_r{i}") == 1) | (F.array_min(F.array_intersect(f"_l{i}", f"_r{i}")) == F.col("_k"))
        new = reduce(lambda x, j: x & ~F.arrays_overlap(f"_l{j}", f"_r{j}"), range(i), first)
        x, y = l.withColumn("_k", F.explode(f"_l{i}")), r.withColumn("_k", F.explode(f"_r{i}"))
        hits.append(x.join(y, "_k").where(new).select(*left.columns, *right.columns))
    return reduce(lambda x, y: x.unionByName(y), hits)


def first_match(base: DataFrame, lookups: list[tuple[DataFrame, str, str]], key: str) -> DataFrame:
    """A cascade of keyed look-ups: for each row of base the hit of the first look-up that has one. lookups: (table, base column, table column)."""
    common = set.intersection(*[set(t.columns) for t, _, _ in lookups])
    cols = [c for c in lookups[0][0].columns if c in common]
    hits = []
    for n, (t, left, right) in enumerate(lookups):
        small = t.select(F.col(right).alias("_k"), F.struct(*cols).alias("_hit")).where("_k is not null")
        hits.append(base.select(key, F.col(left).alias("_k")).join(small, "_k").select(key, F.lit(n).alias("_rank"), "_hit"))
    united = reduce(lambda x, y: x.unionByName(y), hits)
    best = united.groupBy(key).agg(F.min_by("_hit", F.struct("_rank", "_hit")).alias("_hit"), F.min("_rank").alias("matched_by"))
    return base.join(best, key, "left").select(*base.columns, *[F.col("_hit")[c].alias(f"hit_{c}") for c in cols], "matched_by")


def people_of_companies(companies: DataFrame, people: DataFrame, name: str, domain: str, company: str, limit: int = 8) -> DataFrame:
    """companies with people: by the name's key, else people whose company's key contains the domain's first label (of three characters or more)."""
    c = companies.withColumn("_k", X.company_key(F.col(name))).withColumn("_b", F.lower(F.substring_index(F.col(domain), ".", 1)))
    c = c.withColumn("_id", F.concat_ws("\x01", F.coalesce("_k", F.lit("\x02")), F.coalesce("_b", F.lit("\x02"))))  # all that the people depend on
    p = people.withColumn("_pk", X.company_key(F.col(company)))
    entry = F.struct(*people.columns).alias("_p")
    asked = c.select("_id", "_k", "_b").distinct()
    exact = asked.join(p, F.col("_k") == F.col("_pk")).select("_id", entry)
    rest = asked.join(exact.select("_id").distinct(), "_id", "left_anti").where(F.length("_b") >= 3)
    held = containing(rest.select(F.col("_id").alias("needle_id"), F.col("_b").alias("needle")), p.select(F.col("_pk").alias("hay_id"), F.col("_pk").alias("text")).distinct())
    loose = held.join(p, F.col("hay_id") == F.col("_pk")).select(F.col("needle_id").alias("_id"), entry)
    few = first_of(exact.unionByName(loose).distinct(), ["_id"], ["_p"], limit)
    found = few.groupBy("_id").agg(F.array_sort(F.collect_list("_p")).alias("people"))
    return c.join(found, "_id", "left").drop("_id", "_k", "_b")


def new_names(old: DataFrame, new: DataFrame, keys: list[str], name: str) -> DataFrame:
    """old and those rows of new whose name (whatever its case) old lacks, each once."""
    k = F.lower(F.trim(F.col(name)))
    fresh = new.withColumn("_n", k).join(old.withColumn("_n", k).select(*keys, "_n"), [*keys, "_n"], "left_anti").dropDuplicates([*keys, "_n"]).drop("_n")
    return old.unionByName(fresh.select(*old.columns))


def tier_rollup(df: DataFrame, tier: str, confidence: str, tiers: list[str]) -> DataFrame:
    """Count and mean confidence of each fixed tier, those without rows too."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(t, i) for i, t in enumerate(tiers)], "tier string, place int")
    a = df.groupBy(F.col(tier).alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(confidence, F.lit(0.0))).alias("s"))
    out = F.broadcast(dim).join(a, "tier", "left")
    mean = F.try_divide("s", "n")
    return out.select("tier", "place", F.coalesce("n", F.lit(0)).alias("companies"), X.percent_text(mean).alias("confidence"))


def buckets(df: DataFrame, **predicates: Column) -> DataFrame:
    """Counts of several predicates in one pass."""
    return df.agg(*[F.count_if(p).alias(k) for k, p in predicates.items()], F.count(F.lit(1)).alias("total"))


def choices(df: DataFrame, col: str, defaults: list[str]) -> DataFrame:
    fixed = df.sparkSession.createDataFrame([(d,) for d in defaults], f"{col} string")
    return df.where(F.col(col).isNotNull()).select(col).union(fixed).distinct().orderBy(col)


def duplicates(df: DataFrame, key: str, name: str, host: str) -> DataFrame:
    """df with status Duplicate for rows that share a name or a host with a row of lower key, over all rows."""
    first = lambda c: df.where(F.col(c).isNotNull()).groupBy(c).agg(F.min(key).alias(f"_first_{c}"))
    out = df.join(first(name), name, "left").join(first(host), host, "left")
    dup = (F.col(f"_first_{name}") < F.col(key)) | (F.col(f"_first_{host}") < F.col(key))
    return out.withColumn("status", F.when(F.coalesce(dup, F.lit(False)), "Duplicate").otherwise("Unique")).select(*df.columns, "status")


def _grams(text: Column, n: int) -> Column:
    """The distinct substrings of n characters."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(n)))))


def containing(needles: DataFrame, hay: DataFrame) -> DataFrame:
    """needles (needle_id, needle) and hay (hay_id, text) -> the pairs (needle_id, hay_id) whose text contains the needle, wherever in it.

    Equi-joins only: a needle is looked for by its rarest run of three characters (all of it, if it is shorter), the texts that hold that run are
    then tested; one with a run that no text holds is in none. An empty needle is in no text."""
    found = []
    for n in (1, 2, 3):
        size = F.length("needle")
        some = needles.where(size == n if n < 3 else size >= n)
        held = hay.select("hay_id", "text", F.explode(_grams(F.col("text"), n)).alias("gram"))
        counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        asked = some.select("needle_id", "needle", F.explode(_grams(F.col("needle"), n)).alias("gram")).join(counts, "gram", "left")
        rare = asked.groupBy("needle_id", "needle").agg(F.min(F.struct("n", "gram")).alias("r")).where("r.n is not null").select("needle_id", "needle", F.col("r.gram").alias("gram"))
        found.append(rare.join(held, "gram").where(F.contains("text", "needle")).select("needle_id", "hay_id"))
    return reduce(lambda a, b: a.unionByName(b), found).distinct()


#: Most records taken by one request's name, by containment; most candidates shown of the web.
NAMED, FUZZY, SHOWN = 5, 10, 8


def resolve(requests: DataFrame, companies: DataFrame, web: DataFrame | None = None, failed: DataFrame | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """requests (request_id, company_name, domain) against companies (id, canonical_name, legal_name, primary_domain): status and candidates.

    The first look-up that finds anything decides: by domain; by name, as given or without legal forms, against names and legal names; by
    containment of either form in name, legal name or domain. Of names the NAMED first records by id count, of containment the FUZZY first; of
    several records one for each root domain stays, the one with the greatest id. One record, or one root, makes EXISTING, more make AMBIGUOUS. Requests that find
    nothing take web hits (request_id, rank, url, title) of public hosts that are not in blocked (domain): UNIQUE, AMBIGUOUS, or, for
    requests in failed (request_id) without hits, RESOLUTION_RETRY_PENDING; else NOT_FOUND. A name that ilike would take as a pattern
    is taken as it is, and the shown candidates are the first in order.

    Each name, text and root domain is looked up once, with the records that can stay; only these meet the requests, so that many requests for a
    name of many records make no more rows than the bounds allow."""
    name = F.trim("company_name")
    own = F.when(F.contains(name, F.lit(".")), U.root_domain(name))
    r = requests.withColumn("_key", X.company_key(name)).withColumn("_low", F.lower(name)).withColumn("_dom", F.coalesce(X.truthy(U.root_domain(F.col("domain"))), X.truthy(own)))
    c = companies.withColumn("_root", U.root_domain(F.col("primary_domain")))
    hit = F.struct(F.col("id"), F.col("canonical_name"), F.col("primary_domain"), F.col("_root").alias("root"))
    of_root = c.where("_root <> ''").groupBy(F.col("_root").alias("_dom")).agg(F.max(hit).alias("hit"))  # they share a root: the greatest stays
    by_domain = r.select("request_id", "_dom").join(of_root, "_dom").select("request_id", F.lit(0).alias("turn"), "hit")
    names = c.select(F.explode(F.array_distinct(F.array_compact(F.array(F.lower("canonical_name"), F.lower("legal_name"))))).alias("_n"), hit.alias("hit"))
    names = first_of(names.distinct(), ["_n"], ["hit"], NAMED)
    asked = r.select("request_id", F.explode(F.array_distinct(F.array("_low", "_key"))).alias("_n")).where("_n <> ''")
    exact = kept(by_domain.unionByName(asked.join(names, "_n").select("request_id", F.lit(1).alias("turn"), "hit")).distinct(), "resolve-exact")
    open_ = asked.join(exact.select("request_id").distinct(), "request_id", "left_anti")
    fields = F.array_distinct(F.array_compact(F.array(F.lower("canonical_name"), F.lower("primary_domain"), F.lower("legal_name"))))
    texts = kept(first_of(c.select(F.explode(fields).alias("text"), hit.alias("hit")).distinct(), ["text"], ["hit"], FUZZY), "resolve-texts")
    needles = kept(open_.select("_n").distinct(), "resolve-needles").select(F.col("_n").alias("needle_id"), F.col("_n").alias("needle"))
    held = containing(needles, texts.select(F.col("text").alias("hay_id"), "text").distinct()).select(F.col("needle_id").alias("_n"), F.col("hay_id").alias("text"))
    held = first_of(held.join(texts, "text").select("_n", "hit").distinct(), ["_n"], ["hit"], FUZZY)
    loose = open_.join(held, "_n").select("request_id", F.lit(2).alias("turn"), "hit").distinct()
    found = kept(exact.unionByName(loose), "resolve-hits")
    first = found.groupBy("request_id").agg(F.min("turn").alias("turn"))
    found = found.join(first, ["request_id", "turn"])
    by_name = first_of(found.where("turn > 0"), ["request_id"], ["hit"], FUZZY).withColumn("_no", F.row_number().over(W.partitionBy("request_id").orderBy("hit")))
    found = found.where("turn = 0").unionByName(by_name.where((F.col("turn") == 2) | (F.col("_no") <= NAMED)).drop("_no"))
    # one candidate a root domain; one without a root counts if it is alone
    by_root = found.groupBy("request_id", X.truthy(F.col("hit.root")).alias("_r")).agg(F.max("hit").alias("hit"), F.count(F.lit(1)).alias("n"))
    known = by_root.groupBy("request_id").agg(
        F.sum("n").alias("records"), F.count("_r").alias("roots"),
        F.array_sort(F.collect_list(F.when(F.col("_r").isNotNull(), F.struct("hit.id", "hit.canonical_name", "hit.primary_domain")))).alias("hits"), F.max("hit").alias("only"),
    )
    known = known.withColumn("hits", F.when(F.col("records") == 1, F.array(F.struct("only.id", "only.canonical_name", "only.primary_domain"))).otherwise(F.col("hits")))
    known = known.select("request_id", "hits", F.when((F.col("records") == 1) | (F.col("roots") == 1), 1).otherwise(2).alias("known"))
    out = r.join(known, "request_id", "left").withColumn("known", F.coalesce("known", F.lit(0)))
    n, status = F.col("known"), F.when(F.col("known") == 1, "EXISTING").when(F.col("known") > 1, "AMBIGUOUS")
    if web is None:
        return out.select("request_id", "company_name", status.otherwise("NOT_FOUND").alias("status"), F.col("hits").alias("candidates"))
    w = web.withColumn("_h", U.host(F.col("url"))).where((F.col("_h") != "") & ~U.private_host(F.col("_h"))).withColumn("_root", U.root_domain(F.col("_h"))).where("_root <> ''")
    w = w.groupBy("request_id", "_root").agg(F.min_by("title", "rank").alias("title"), F.min("rank").alias("rank"))
    if blocked is not None:
        w = w.join(blocked.select(F.lower("domain").alias("_root")).distinct(), "_root", "left_anti")
    title = F.coalesce(X.truthy(F.col("title")), F.initcap(F.substring_index("_root", ".", 1)))
    w = w.withColumn("_no", F.row_number().over(W.partitionBy("request_id").orderBy("rank", "_root")))
    seen = w.groupBy("request_id").agg(F.count(F.lit(1)).alias("on_web"), F.array_sort(F.collect_list(F.when(F.col("_no") <= SHOWN, F.struct("rank", title.alias("canonical_name"), F.col("_root").alias("domain"))))).alias("web_hits"))
    out = out.join(seen, "request_id", "left").withColumn("on_web", F.coalesce("on_web", F.lit(0)))
    lost = F.lit(False)
    if failed is not None:
        out = out.join(failed.select("request_id").distinct().withColumn("_failed", F.lit(True)), "request_id", "left")
        lost = F.coalesce("_failed", F.lit(False))
    seen_status = F.when(F.col("on_web") == 1, "UNIQUE").when(F.col("on_web") > 1, "AMBIGUOUS").when(lost, "RESOLUTION_RETRY_PENDING").otherwise("NOT_FOUND")
    return out.select("request_id", "company_name", F.coalesce(status, seen_status).alias("status"), F.col("hits").alias("candidates"), F.when(n == 0, F.col("web_hits")).alias("web_candidates"))


def request_error(company_name: Column, domain: Column | None = None) -> Column:
    """What is wrong with a request, null if nothing is: names have 2 to 200 characters, domains a dot."""
    n = F.length(F.trim(F.coalesce(company_name, F.lit(""))))
    e = F.when(n < 2, "company_name must be at least 2 characters").when(n > 200, "company_name must be under 200 characters")
    return e if domain is None else e.when(~F.contains(F.replace(F.lower(F.trim(F.coalesce(domain, F.lit("")))), F.lit("www."), F.lit("")), F.lit(".")), "domain must be a valid domain name")


def investigate(requests: DataFrame, sessions: DataFrame, as_of, running: list[str]) -> DataFrame:
    """requests (request_id, domain, blocked) with the decision: bad host, blocked, cached, running or to be queued."""
    newest = latest_by(sessions.select("domain", "status", "updated_at", "verified_at", "id"), ["domain"], ["updated_at", "id"])
    j = requests.join(newest, "domain", "left")
    fresh = X.fresh(F.col("status"), F.col("updated_at"), F.col("verified_at"), as_of)
    d = F.when(U.private_host(F.col("domain")), "REJECTED_PRIVATE").when(F.col("blocked"), "REJECTED_BLOCKED").when(fresh, "CACHE_HIT").when(F.col("status").isin(running), "ALREADY_RUNNING").otherwise("AGENT1_QUEUED")
    return j.select("request_id", "domain", d.alias("decision"), F.when(d == "AGENT1_QUEUED", 9).alias("priority"))


#: Rows of vectors and queries that meet at once, in one matrix product; sizes of tasks depend on it, results don't.
BLOCK = 2048
#: The approximate index: cells, vectors of a sample of bounded size that they are learned from, queries and recall that the probes are chosen by.
CELLS, SAMPLE, TRIED, RECALL = 32, 8192, 256, 0.95


def _packed(rows: DataFrame, cell: str, number: Column, key: str, vector: str, keys: str, values: str) -> DataFrame:
    """rows packed by (cell, number): one row with the keys and one long array of the vectors' numbers."""
    v = F.col(vector)  # null, empty and broken vectors are like none; those of unequal lengths never meet
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, F.isnull))
    g = rows.groupBy(F.col(cell).alias("cell"), F.size(v).alias("dims"), number.alias("_no")).agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))).alias("p"))
    return g.select("cell", "dims", F.col("p.k").alias(keys), F.flatten("p.v").alias(values))


def _block_best(k: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                keys, ids = b.column("keys")[i].values, b.column("ids")[i].values
                v, q = (b.column(c)[i].values.to_numpy(zero_copy_only=False).reshape(n, -1) for c, n in (("rows", len(keys)), ("vectors", len(ids))))
                norm = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))[None, :]
                score = np.where(norm > 0, np.round(q @ v.T / np.where(norm > 0, norm, 1.0), 6), -2.0)  # a zero vector is like none
                most = min(k, len(keys))
                least = np.partition(score, -most, axis=1)[:, -most]
                at, col = np.nonzero((score >= least[:, None]) & (score >= -1.0))
                value, key = score[at, col], keys.take(pa.array(col))
                order = np.lexsort((key.to_numpy(zero_copy_only=False), -value, at))
                at, value = at[order], value[order]
                starts = np.searchsorted(at, at, "left")
                few = np.arange(len(at)) - starts < k  # of equal scores the least keys
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[few])), key.take(pa.array(order[few])), pa.array(value[few])], names=["query_id", "key", "score"])

    return run


def _best(packs: DataFrame, blocks: DataFrame, k: int, key: str) -> DataFrame:
    """The k best of each query over the pairs of packs (cell, keys, rows) and blocks (cell, ids, vectors) of one cell."""
    kind = lambda df, c: df.schema[c].dataType.elementType.simpleString()
    met = packs.join(blocks, ["cell", "dims"]).select("keys", "rows", "ids", "vectors")
    some = met.mapInArrow(_block_best(k), f"query_id {kind(blocks, 'ids')}, key {kind(packs, 'keys')}, score double")
    some = some.withColumnRenamed("key", key)
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    return some.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Exact cosine top-k of queries (query_id, query), as many as there are, against all vectors: query_id, key, score, rank.

    Both sides are dealt to packs by hash; each pack of vectors meets each block of queries once, in a matrix product that keeps k rows for each
    query. Packs find blocks by an equi-join on the block's number, so no task holds a side. The driver sees two counts."""
    n_blocks, n_packs = (max(1, -(-df.count() // block)) for df in (queries, vectors))
    q = queries.where("query_id is not null").withColumn("_c", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))
    blocks = _packed(q, "_c", F.lit(0), "query_id", "query", "ids", "vectors")
    v = vectors.withColumn("_c", F.pmod(F.xxhash64(key), F.lit(n_packs)))
    packs = _packed(v, "_c", F.lit(0), key, embedding, "keys", "rows").withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>")))
    return _best(packs, blocks, k, key)


def _cells(centres):
    """Adds, to rows with an array `v`, the cells of the nearest centres of its direction, nearest first."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, centres.shape[1]))
            near = np.argsort(-(v @ centres.T), axis=1, kind="stable").astype(np.int64)
            ends = np.arange(0, near.size + 1, centres.shape[0], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("v"), pa.ListArray.from_arrays(pa.array(ends), pa.array(near.ravel()))], names=["k", "v", "near"])

    return run


def top_k_approximate(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", embedding: str = "embedding", cells: int = CELLS, probes: int | None = None, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """Approximate cosine top-k of queries (query_id, query): an inverted file. Centres are learned by spherical k-means from a sample of at
    most `sample` vectors, every vector goes to its nearest centre's cell, a query looks into the cells nearest to it: `probes`, or as many as find
    RECALL of the true neighbours inside the sample, so that vectors without clusters get more of them. The caller measures recall."""
    import numpy as np

    rows = vectors.select(F.col(key).alias("k"), F.col(embedding).cast("array<double>").alias("v")).where("k is not null and size(v) > 0")
    some = np.array([r.v for r in rows.orderBy(F.xxhash64("k"), "k").limit(sample).collect()], np.float64)
    if not len(some):
        return top_k(vectors, queries, k, key, embedding)
    some /= np.maximum(np.sqrt((some**2).sum(axis=1, keepdims=True)), 1e-12)
    centres = some[np.linspace(0, len(some) - 1, min(cells, len(some))).astype(int)]
    for _ in range(12):
        own = np.argmax(some @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, some)
        size = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    if probes is None:
        tried = some[:: max(1, len(some) // TRIED)][:TRIED]
        true = np.argsort(-(tried @ some.T), axis=1, kind="stable")[:, : k + 1]
        place = np.argsort(np.argsort(-(tried @ centres.T), axis=1, kind="stable"), axis=1)
        own = np.argmax(some @ centres.T, axis=1)
        needed = np.sort(np.take_along_axis(place, own[true], axis=1).ravel())
        probes = int(needed[min(len(needed) - 1, int(RECALL * len(needed)))]) + 1
    schema = lambda df: f"k {df.schema['k'].dataType.simpleString()}, v array<double>, near array<long>"
    v = rows.mapInArrow(_cells(centres), schema(rows)).select("k", "v", F.col("near")[0].alias("c"))
    asked = queries.select(F.col("query_id").alias("k"), F.col("query").cast("array<double>").alias("v")).where("k is not null")
    q = asked.mapInArrow(_cells(centres), schema(asked)).select("k", "v", F.explode(F.slice("near", 1, probes)).alias("c"))
    n_packs, n_blocks = (max(1, -(-df.count() // (block * cells // 2))) for df in (vectors, queries))
    packs = _packed(v, "c", F.pmod(F.xxhash64("k"), F.lit(n_packs)), "k", "v", "keys", "rows")
    blocks = _packed(q, "c", F.pmod(F.xxhash64("k"), F.lit(n_blocks)), "k", "v", "ids", "vectors")
    return _best(packs, blocks, k, key)


def crawl_frontier(seeds: DataFrame, links: DataFrame, rounds: int, per_page: int = 5) -> DataFrame:
    """Breadth-first over links (src, dst, score) of one site: url, depth. Each round is an anti-join with what was visited; at most per_page
    noise links (score 2) follow from a page, the best scored first. The loop is over depths, not rows."""
    seen = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    edge = seen
    for d in range(1, rounds + 1):
        w = W.partitionBy("src", (F.col("score") == 2)).orderBy("score", "dst")
        out = links.join(edge.select(F.col("url").alias("src")), "src").where(U.same_site(F.col("dst"), F.col("src")))
        out = out.withColumn("_n", F.row_number().over(w)).where((F.col("score") < 2) | (F.col("_n") <= per_page))
        edge = out.select(F.col("dst").alias("url")).distinct().join(seen, "url", "left_anti").withColumn("depth", F.lit(d))
        edge = kept(edge, "frontier")
        seen = seen.unionByName(edge)
    return seen


def pick_evidence(candidates: DataFrame, session: str = "session_id") -> DataFrame:
    """Candidates (session, field, strategy_order, value, source_url, snippet, method): the value of the first strategy that found one."""
    v = candidates.where(X.truthy(F.col("value")).isNotNull())
    best = v.groupBy(session, "field").agg(F.min_by(F.struct("value", "source_url", "snippet", "method"), F.struct("strategy_order", "value")).alias("b"))
    return best.select(session, "field", "b.*")
