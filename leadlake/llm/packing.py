"""Harmonic packing: pieces of documents go to classes of reciprocal capacity, and each bin of class i takes exactly i pieces.

A document longer than the capacity C gives full pieces of C. What is left, of length r, belongs to class i = C div r, whose bins hold i
pieces of at most C div i. If r falls short of that by no more than a small share, it stays whole; else a piece of exactly C div (i + 1) is
cut off for class i + 1 and the rest is dealt with likewise. There are at most about 2 * sqrt(C) classes. A piece's place follows from its
rank in its class: rank div i is the bin. Ranks come from counts of each (class, input part), so classes and parts fill independently and
no task sees a whole class. Only the last, not full bin of each class is repacked: these pieces are fewer than the sum of all class sizes, a
constant, and go best-fit into common bins.

Defined results: null text is empty (its document is the end id alone); null and repeated doc_id are kept as rows of their own; an empty table
gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leadlake.llm._common import body, cut, lean, tasks
from leadlake.llm.tokens import chunks, crc, default_path, encoder

CAPACITY = 4096
#: A piece stays whole if it fills its slot but for this share; slots of at most SMALL tokens take what comes.
SLACK, SMALL = 0.02, 64
#: Bytes of text that a task encodes at once, and words that its encoder keeps: they bound a worker's memory, never results.
CHUNK_BYTES, CACHE_WORDS = 1 << 20, 200_000


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of that many tokens, in order."""
    out = [(capacity, 1)] * (length // capacity)
    r = length % capacity
    while r:
        i = capacity // r
        slot = capacity // i
        if r <= SMALL or slot - r <= SLACK * slot:
            out.append((r, i))
            break
        piece = capacity // (i + 1)
        out.append((piece, capacity // piece))
        r -= piece
    return out


def _cutter(tokenizer: str, capacity: int):
    def run(batches):
        import functools

        import pyarrow as pa
        from pyspark import TaskContext

        lean(forget=False)
        enc, of, part, seq = encoder(tokenizer, CACHE_WORDS), functools.lru_cache(100_000)(lambda n: cuts(n, capacity)), TaskContext.get().partitionId(), 0
        for b in batches:
            ids_of = b.column("doc_id")
            for i, c in chunks(b.column("text"), CHUNK_BYTES):
                ids, starts = enc.encode(c)
                doc, first, size, kind, sums = [], [], [], [], []
                for d, (a, z) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                    for n, k in of(z - a):
                        doc.append(d)
                        first.append(a)
                        size.append(n)
                        kind.append(k)
                        sums.append(crc(ids[a : a + n]))
                        a += n
                doc, size = np.asarray(doc, np.int64), np.asarray(size, np.int64)
                m = len(doc)
                yield pa.RecordBatch.from_arrays(
                    [ids_of.take(pa.array(doc + i)), pa.array(np.asarray(first, np.int64) - starts[doc]), pa.array(size), pa.array(np.asarray(sums, np.int64)), pa.array(np.diff(starts)[doc]), pa.array(np.asarray(kind, np.int32)), pa.array(np.full(m, part, np.int32)), pa.array(np.arange(seq, seq + m, dtype=np.int64))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "part", "seq"],
                )
                seq += m

    return run


def _best_fit(capacity: int):
    def run(pdf):
        """Longest first into the fullest open bin that has room; bins by free space."""
        pdf = pdf.sort_values(["length", "part", "seq"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        free: dict[int, list[int]] = {}
        bins, offsets, n = [], [], 0
        for size in pdf["length"].tolist():
            room = min((k for k in free if k >= size and free[k]), default=None)
            if room is None:
                at, room, n = n, capacity, n + 1
            else:
                at = free[room].pop()
                if not free[room]:
                    del free[room]
            bins.append(at)
            offsets.append(capacity - room)
            free.setdefault(room - size, []).append(at)
        pdf["bin"], pdf["offset"] = np.asarray(bins, np.int64), np.asarray(offsets, np.int64)
        return pdf

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, class, sequence_id, offset: one row for each piece."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, part int, seq long"
    pieces = cut(rows.mapInArrow(_cutter(tokenizer or default_path(), capacity), schema), "pack-pieces")
    counts = pieces.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"))
    ordered = W.partitionBy("class").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = cut(counts.select("class", "part", F.coalesce(F.sum("n").over(ordered), F.lit(0)).alias("before"), "n"), "pack-counts", 1)
    full = counts.groupBy("class").agg(F.floor(F.sum("n") / F.col("class")).cast("long").alias("bins"))
    base = F.coalesce(F.sum("bins").over(W.orderBy("class").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    full = full.select("class", "bins", base.alias("base"))
    offsets = cut(counts.drop("n").join(full, "class"), "pack-offsets", 1)
    ranked = pieces.join(offsets, ["class", "part"]).withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy("class", "part").orderBy("seq")) - 1)
    ranked = cut(ranked.withColumn("bin", F.expr("rank div class")), "pack-ranked", tasks(pieces))
    whole = ranked.where("bin < bins").withColumn("sequence_id", F.col("base") + F.col("bin"))
    inside = W.partitionBy("sequence_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "sequence_id", "offset"]
    whole = whole.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long"))
    last = ranked.where("bin >= bins").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "part", "seq")
    last = last.groupBy().applyInPandas(_best_fit(capacity), f"{schema}, bin long, offset long")
    total = full.agg(F.coalesce(F.sum("bins"), F.lit(0))).first()[0]
    last = last.withColumn("sequence_id", F.col("bin") + F.lit(int(total)).cast("long"))
    return whole.select(*cols).unionByName(last.select(*cols))


def op6(docs: DataFrame) -> DataFrame:
    return pack(docs)
