"""Mixing sources to target weights.

Each document gets a hash-random key (md5 of its id), the rows are range-sorted within each source, a distributed prefix sum gives the
words before each document, and the source is cut at its exact budget: whole epochs first, then the documents up to the cut, of which the
last may be taken in part.

Targets: source number i (by code point, null last) weighs 1 + i mod 3; targets share all words by weight; none exceeds three times its
source's size, what is above goes to the others by weight. That fixed point is min(3 * size, lambda * weight) with one lambda for all, found
by one pass over the sources in the order of 3 * size / weight.

Defined results: null text has size 0; a null source is a source of its own; rows with equal doc_id are ordered by their texts' hash;
empty tables give empty results; other columns are left alone.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leadlake.llm._common import body, boxed, cut, number, prefix, tasks, word_count

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3


def targets(sizes: DataFrame, weights=WEIGHTS, most=MOST_EPOCHS) -> DataFrame:
    """sizes (key, source, source_size), a row for each source -> the same with target. One task, over as many rows as there are sources."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size") * most)
    rising = W.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    all_, here = W.partitionBy(), rising.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("_t", F.sum("source_size").over(all_)).withColumn("_caps", F.coalesce(F.sum("_cap").over(here), F.lit(0))).withColumn("_left", F.sum("_w").over(rising.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("_lam", (F.col("_t") - F.col("_caps")) / F.col("_left")).withColumn("_free", F.col("_cap") >= F.col("_lam") * F.col("_w"))
    s = s.withColumn("_lambda", F.min(F.when(F.col("_free"), F.struct(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source", "_lam"))).over(all_)["_lam"])
    return s.select("key", "source", "source_size", F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_lambda") * F.col("_w"), F.lit(0.0))).alias("target"))


def _key() -> Column:
    """The source as a string that is never null."""
    return F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, words_before, taken for each row of docs."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        _key().alias("key"),
        word_count(body()).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_h"), F.xxhash64(body()).alias("_x"),
    )
    rows = cut(rows, "mix-rows")
    sizes = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    goal = cut(targets(sizes), "mix-targets", 1).drop("source")
    placed = prefix(rows, ["_h", "doc_id", "_x"], "size", "key", "mix").withColumnRenamed("_before", "words_before")
    out = placed.join(goal, "key")
    budget = F.floor(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("words_before")))
    return out.select("doc_id", "source", "size", "source_size", "target", "words_before", taken.cast("long").alias("taken"), "_x")


def materialise(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as often as its words are taken; a copy that is cut ends with the last word taken. Columns as in docs.

    Rows of one doc_id, text and source share what is taken of them all: whole copies are dealt out evenly, a cut one comes once.
    """
    same = ["id", "x", "key"]
    taken = mix(docs).groupBy(F.col("doc_id").alias("id"), F.col("_x").alias("x"), _key().alias("key"))
    taken = cut(taken.agg(F.max("size").alias("size"), F.sum("taken").alias("words"), F.count(F.lit(1)).alias("rows")).where("words > 0"), "mix-taken", tasks(docs))
    rows = boxed(docs, id=number(), x=F.xxhash64(body()), key=_key())
    on = lambda left, right: reduce(and_, [left[c].eqNullSafe(right[c]) for c in same])
    once = taken.where("rows = 1")
    out = rows.join(once, on(rows, once)).select("row", "size", F.col("words").alias("words"))
    more = taken.where("rows > 1")
    if not more.isEmpty():
        again = cut(rows.join(more, on(rows, more), "left_semi").withColumn("no", F.monotonically_increasing_id()).withColumn("one", F.lit(1).cast("long")), "mix-again")
        ranked = prefix(again.select("id", "x", "key", "no", "one"), [*same, "no"], "one", None, "mix-again")
        first = ranked.groupBy([F.col(c).alias(f"f{c}") for c in same]).agg(F.min("_rank").alias("first"))
        ranked = ranked.join(first, reduce(and_, [F.col(c).eqNullSafe(F.col(f"f{c}")) for c in same])).select("no", *same, (F.col("_rank") - F.col("first")).alias("at"))
        part = F.expr("if(at < words div size % rows, size, if(at = words div size % rows, words % size, 0))")
        share = ranked.join(more, on(ranked, more)).select("no", "size", (F.expr("words div size div rows") * F.col("size") + part).alias("words"))
        out = out.unionByName(again.select("row", "no").join(share, "no").select("row", "size", "words").where("words > 0"))
    copies = out.withColumn("left", F.explode(F.expr("transform(sequence(0, cast((words - 1) div size as int)), i -> least(size, words - i * size))")))
    whole = F.col("left") == F.col("size")
    text = F.expr(r"array_join(slice(regexp_extract_all(coalesce(row.text, ''), '[ \\x09-\\x0D]*[^ \\x09-\\x0D]+', 0), 1, cast(left as int)), '')")
    cols = {c: F.col("row").getField(c) for c in docs.columns}
    cols["text"] = F.when(whole, cols["text"]).otherwise(text)
    if "n_chars" in cols:
        cols["n_chars"] = F.when(whole, cols["n_chars"]).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return copies.select(*[c.alias(n) for n, c in cols.items()])


def op10(docs: DataFrame) -> DataFrame:
    return mix(docs).drop("_x")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS w FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS k FROM s),
c AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS t, CAST(coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS caps,
             sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM r),
l AS (SELECT *, (t - caps) / rest AS lam FROM c),
f AS (SELECT arg_min(lam, k) AS lam FROM l WHERE cap >= lam * w),
g AS (SELECT l.source, l.source_size, least(CAST(l.cap AS DOUBLE), coalesce(f.lam * l.w, 0)) AS target FROM l, f),
p AS (SELECT d.*, g.source_size, g.target, CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS words_before
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
b AS (SELECT *, CAST(floor(target) AS BIGINT) AS budget, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, source, size, source_size, target, words_before,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - words_before)) AS BIGINT) AS taken FROM b
"""
