"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension becomes a number (numbers as they are, other values by their rank among the distinct values), is quantised by edges that
halve its rows again and again (approximate quantiles over all rows), and the cells get their index on the Hilbert curve. Rows are
ordered by that index, equal texts of a cell side by side, and the order is cut in runs, so each shard covers a compact box of the
dimensions and its statistics prune files in every one of them. The law is `rows`: shard sizes differ by one row at most.

Defined results: null text has size 1; null in a dimension comes first; ties are ordered by text hash and doc_id; an empty table gives an empty
result; other columns are left alone.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlake.llm._common import body, cut, free, prefix, tasks

BITS = 4
SHARDS = 16
ACCURACY = 1000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """cells (rows, dimensions) of numbers below 2**bits -> the rows' places on the Hilbert curve (Skilling's transform, all rows at once)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    fix = np.zeros_like(x[0])
    q = top
    while q > 1:
        fix ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= fix
    out = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for i in range(dims):
            out = out << 1 | x[i] >> b & 1
    return out


def _numbers(df: DataFrame, dims: list[str]) -> tuple[DataFrame, list[str]]:
    """df with a number for each dimension: numbers as they are, other values by their rank among the distinct values (whole strings by code point)."""
    names = []
    for i, dim in enumerate(dims):
        names.append(name := f"_d{i}")
        if isinstance(df.schema[dim].dataType, T.NumericType):
            df = df.withColumn(name, F.col(dim).cast("double"))
            continue
        values = df.where(F.col(dim).isNotNull()).groupBy(F.col(dim).cast("string").alias("_value")).agg(F.lit(1).cast("long").alias("_one"))
        ranks = prefix(values, ["_value"], "_one", None, "hilbert-values").select(F.col("_value").alias(f"_v{i}"), F.col("_rank").cast("double").alias(name))
        df = df.join(ranks, F.col(dim).cast("string") == F.col(f"_v{i}"), "left").drop(f"_v{i}")
    return df, names


def curve(df: DataFrame, dims: list[str], bits: int = BITS) -> DataFrame:
    """df with _curve, the Hilbert index of each row's quantised dims."""
    rows = df
    df, numbers = _numbers(df, dims)
    df = cut(df, "hilbert-numbers", tasks(rows))
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    edges = df.agg(*[F.percentile_approx(c, F.array(*map(F.lit, shares)), F.lit(ACCURACY)).alias(c) for c in numbers]).first()
    cells = [
        F.when(F.col(c).isNull(), 0).otherwise(reduce(lambda a, b: a + b, [(F.col(c) > F.lit(float(e))).cast("int") for e in (edges[c] or [0.0])])) for c in numbers
    ]

    @F.pandas_udf("long")
    def place(cell: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(cell.to_numpy(np.int64), bits))

    return df.withColumn("_curve", place(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cells)]))).drop(*numbers)


def shards(docs: DataFrame, dims: list[str], shard_count: int = SHARDS, bits: int = BITS, keep: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row, dims kept under their names with a leading dim_, keep as it is."""
    kept = [keep] if keep else []
    light = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(body()) + 1).cast("long").alias("size"), F.crc32(body()).alias("text_crc32"),
        F.xxhash64(body()).alias("_text"), *kept, *[F.col(d).alias(f"dim_{d}") for d in dims if d != "size"],
    )
    light = cut(light, "hilbert-light")
    placed = curve(light, [f"dim_{d}" if d != "size" else "size" for d in dims], bits)
    placed = cut(placed.withColumn("_one", F.lit(1).cast("long")), "hilbert-curve")
    ranked = prefix(placed, ["_curve", "_text", "doc_id"], "_one", None, "hilbert").drop("_before")
    n = max(1, placed.count())
    shard = F.expr(f"cast(_rank * {shard_count} div {n}L as int)")
    first = F.expr(f"cast(shard * {n}L div {shard_count} + if(shard * {n}L % {shard_count} > 0, 1, 0) as long)")
    out = ranked.withColumn("shard", shard).withColumn("slot", F.col("_rank") - first)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "_curve", *kept, *[c for c in out.columns if c.startswith("dim_")])


def write_shards(docs: DataFrame, folder: str, dims: list[str], shard_count: int = SHARDS) -> None:
    """The documents, one folder shard=k for each shard, in curve order inside; Parquet statistics then prune by every dim. docs has no column shard."""
    no, slot = free(docs, "no"), free(docs, "slot")
    rows = cut(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias(no)), "hilbert-rows")
    light = rows.select(no, *[F.col(f"row.{c}").alias(c) for c in dict.fromkeys(["doc_id", "text", *dims]) if c in docs.columns])
    at = shards(light, dims, shard_count, keep=no).select(no, "shard", F.col("slot").alias(slot))
    out = rows.join(at, no).select("row.*", "shard", slot)
    out.repartition("shard", F.floor(F.col(slot) / 1_000_000)).sortWithinPartitions("shard", slot).drop(slot).write.partitionBy("shard").parquet(folder)


def op4(docs: DataFrame) -> DataFrame:
    return shards(docs, ["source", "lang", "size"])
