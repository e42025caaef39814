"""Exact dedup by a log-structured merge index of text digests. DataFrame operations only.

Memtable: the digests of one input task. Flush: each memtable is folded to one entry for each digest and written as a sorted run with
Parquet Bloom filters, which serve look-ups of single digests (lookup). Compaction: FAN runs at a time merge into one run of the next level, each
level a written, sorted table with filters of its own, until at most FAN are left; these merge into the last level, which
holds, for each digest, the identifier that stays and the group's size. Hits (digests of more than one row) are verified byte by byte: one bitmap
filter of bounded size over hit digests stands in for the runs' filters there and picks the rows whose texts must travel, and a group is one text
exactly if its least and greatest texts are equal, which partial aggregation finds without gathering the group. Digests shared by different texts are then regrouped by the texts themselves.

Defined results: null text equals empty text; a null doc_id ranks below every other; of repeated rows with one doc_id and text one row is
kept; an empty table gives an empty result; further columns, whatever their names, are left alone by survivors().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leadlake.llm._common import bitmap, body, boxed, cut, maybe_in, number, tasks

#: Filters of the runs and the level, for look-ups of single digests.
_BLOOM = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.max.bytes": "1048576"}

FAN = 64  # runs that one merge takes


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _slot() -> Column:
    """A digest's place in the bitmap filter."""
    return F.xxhash64("digest").alias("slot")


def _merged(entries: DataFrame, *by: str) -> DataFrame:
    """One entry for each digest: the identifier that stays (of repeated rows the first one's) and how many rows there are."""
    return entries.groupBy(*by, "digest").agg(F.max("best").alias("best"), F.sum("n").alias("n"))


def levels(log: DataFrame) -> list[DataFrame]:
    """log (doc_id, digest, run, pos), a written table -> the levels (run, digest, best, n), the flushed runs first, each with at most 1 / FAN of the
    runs of the one before; the last has at most FAN runs."""
    entry = F.struct(F.col("doc_id").alias("id"), (-F.col("pos")).alias("neg")).alias("best")
    flushed = _merged(log.select("run", "digest", entry, F.lit(1).cast("long").alias("n")), "run")
    out = [cut(flushed.sortWithinPartitions("run", "digest"), "lsm-run", **_BLOOM)]
    many = (log.agg(F.max("run")).first()[0] or 0) + 1
    while many > FAN:
        many = -(-many // FAN)
        next_ = _merged(out[-1].withColumn("run", F.expr(f"cast(run div {FAN} as int)")), "run")
        out.append(cut(next_.coalesce(tasks(log)).sortWithinPartitions("run", "digest"), f"lsm-level-{len(out)}", **_BLOOM))
    return out


def index(docs: DataFrame, digest=sha256) -> DataFrame:
    """One row for each row of docs: doc_id, digest, keep_id, group_size, kept."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text")))
    log = cut(rows.select("doc_id", "digest", F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("pos")), "lsm-log")
    n = tasks(log)
    hits = cut(_merged(levels(log)[-1]).where("n > 1").coalesce(n).sortWithinPartitions("digest"), "lsm-level-hits", **_BLOOM)
    probes = maybe_in(rows.select("*", _slot()), "slot", bitmap(hits.select(_slot()), "slot"))
    verified = probes.groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
    clash = cut(verified.where("lo <> hi").select("digest"), "lsm-clash", n)
    found = log.join(hits, "digest", "left").select(
        "doc_id", "digest", "pos", F.expr("if(n is null, doc_id, best.id)").alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.expr("n is null or pos = -best.neg").alias("kept"),
    )
    if clash.isEmpty():
        return found.drop("pos")
    own = rows.join(clash, "digest", "left_semi")
    w = ["digest", "text"]
    by_text = own.groupBy(*w).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    numbered = own.join(by_text, w).withColumn("_no", F.row_number().over(W.partitionBy("digest", "text", "doc_id").orderBy(F.lit(1))))
    exact = numbered.select("doc_id", "digest", "keep_id", "group_size", F.expr("doc_id <=> keep_id and _no = 1").alias("kept"))
    return found.drop("pos").join(clash, "digest", "left_anti").unionByName(exact)


def lookup(runs: DataFrame, texts: list[str]) -> DataFrame:
    """Entries of written runs or levels (digest, ...) for a few texts: the digests are pushed to the scan, where the files' Bloom filters are asked."""
    from hashlib import sha256 as digest

    return runs.where(F.col("digest").isin([bytearray(digest(t.encode()).digest()) for t in texts]))


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns. Of repeated rows with one doc_id and text any one stays."""
    n = tasks(docs)
    found = cut(index(docs), "lsm-found", n)
    ids = found.groupBy("doc_id").agg(F.count_if("kept").alias("k"), F.count(F.lit(1)).alias("n"))
    odd = cut(ids.where("k < n").select(F.col("doc_id").alias("id"), "k"), "lsm-drop", n)
    all_ = boxed(docs, own=number())
    out = all_.join(odd, F.col("own").eqNullSafe(F.col("id")), "left_anti").select("row.*")
    mixed = odd.where("k > 0").select("id")
    if mixed.isEmpty():
        return out
    # ids of which some rows stay: their texts tell which
    stay = found.where("kept").select(F.col("doc_id").alias("id"), F.col("digest").alias("stays")).distinct()
    some = boxed(docs, own=number(), digest=sha256(body())).join(mixed, F.col("own").eqNullSafe(F.col("id")), "left_semi")
    some = some.join(stay, F.col("own").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("stays")), "left_semi")
    return out.unionByName(some.groupBy("own", "digest").agg(F.first("row").alias("row")).select("row.*"))


def op5(docs: DataFrame) -> DataFrame:
    return index(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
             count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size FROM documents)
"""
