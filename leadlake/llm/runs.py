"""Periodic runs of words, after Ellert and Fischer: Lyndon arrays of both orders of the alphabet, matched extensions used again.

A run with smallest period q holds a Lyndon word of length q, in the alphabet's order or in its reverse, that is the longest Lyndon word at its place. So
the pairs (i, end of the longest Lyndon word at i), taken in both orders and extended to both sides, give all runs. The Lyndon array comes
from right to left by comparing suffixes. How far two suffixes match follows from extensions already known wherever it can: the one between a place and
its next smaller suffix, or the last one at the same distance, where the new one meets it. Symbols at one distance are thus compared once, and no
suffix array, tree or fingerprint is made.

Runs with few repetitions are everywhere; callers ask for length >= max(least, times * period). In such a run all words but those of the last period
come again within q <= length / times words, so stretches in which that fails are passed over before (`stretches`): they hold no such run.

The words of a row are one array in one task: a row is one document, whatever its length, and nothing is shuffled.

Defined results: null text has no words; a null doc_id, repeated rows and ties give their own rows; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm._common import body

#: Words that are numbered and searched at once in a task; a longer document is alone.
CHUNK_WORDS = 200_000

_SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def lyndon(w: list[int]) -> tuple[list[int], list[int]]:
    """For each place the start of the next smaller suffix (the end of its longest Lyndon word), and how many symbols both suffixes share."""
    n = len(w)
    nss, ext = [n] * n, [0] * n
    met, length = [-1] * (n + 1), [0] * (n + 1)  # for each distance: the place of its last extension, and how far that went
    for i in range(n - 2, -1, -1):
        j, known = i + 1, 0
        here = w[i]
        while True:
            if known == 0 and here != w[j]:
                shared = 0
            else:
                d, a = j - i, i + known
                stop = met[d]
                if 0 <= stop <= a:
                    a = stop + length[d]
                else:
                    last = n - d
                    while a < last and w[a] == w[a + d]:
                        a += 1
                        if a == stop:
                            a += length[d]
                            break
                shared = a - i
                met[d], length[d] = i, shared
            # walk on over suffixes that are greater than this one
            while j + shared < n and w[i + shared] < w[j + shared]:
                k, e = nss[j], ext[j]
                if k == n:
                    j, shared = n, 0
                    break
                j = k
                if shared == e:
                    break  # both share as much with the one passed: compare on
                if e < shared:
                    shared = e
            else:
                e = -1
            if j == n or e != shared or j + shared == n:
                break
            known = shared
        nss[i], ext[i] = j, shared
    return nss, ext


def all_runs(w: list[int]) -> set[tuple[int, int, int]]:
    """All maximal repetitions (start, length, smallest period) of length >= 2 * period."""
    n, out = len(w), set()
    for order in (1, -1):
        v = w if order == 1 else [-x for x in w]
        nss, ext = lyndon(v)
        inside = [-1] * (n + 1)  # for each period: the last place whose root lies in the run found last
        for i in range(n):
            j = nss[i]
            q = j - i
            if i <= inside[q]:
                continue
            s, t = i, j
            while s and w[s - 1] == w[t - 1]:
                s -= 1
                t -= 1
            e = j + ext[i]
            if e - s >= 2 * q:
                out.add((s, e - s, q))
                inside[q] = e - q
    return out


def stretches(codes: np.ndarray, doc: np.ndarray, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(first, last + 1, longest period) of the maximal stretches whose words all come again, in their document, within that period; no run with
    length >= max(least, times * period) has its start, or any word but those of its last period, elsewhere."""
    n = len(codes)
    if not n:
        return
    key = doc.astype(np.int64) << 32 | codes.astype(np.int64)
    order = np.argsort(key, kind="stable")
    again = np.full(n, n + 1, np.int64)
    same = key[order[1:]] == key[order[:-1]]
    again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    at = np.flatnonzero(again <= n)  # the last word of a document is never among them: stretches end with documents
    while len(at):
        gap = np.flatnonzero(np.diff(at) != 1) + 1
        first, last = np.concatenate([[0], gap]), np.concatenate([gap, [len(at)]])
        longest = (last - first) // (times - 1)
        longest[(last - first) < least - 1] = 0  # a run of period 1; longer periods need more, as longest says
        keep = again[at] <= np.repeat(longest, last - first)
        if keep.all():
            for f, t, q in zip(at[first].tolist(), at[last - 1].tolist(), longest.tolist()):
                yield f, t + 1, q
            return
        at = at[keep]


def _find(codes: np.ndarray, starts: np.ndarray, least: int, times: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each document; codes are the words' ranks, documents one after the other from `starts` on (with the end)."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(starts) - 1)]
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    for f, t, q in stretches(codes, doc, least, times):
        d = int(doc[f])
        end, base = min(t + q, int(starts[d + 1])), int(starts[d])
        for s, length, period in all_runs(codes[f:end].tolist()):
            if s < t - f and length >= max(least, times * period):  # a run that starts behind the stretch has its own
                found[d].append((f - base + s, length, period))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in found]


def _detector(least: int, times: int, cycle: Callable[[int, int], tuple[int, int] | None] | None):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        out_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

        def flush(ids, texts):
            starts = np.zeros(len(texts) + 1, np.int64)
            np.cumsum([len(t) for t in texts], out=starts[1:])
            coded = pa.array([w for t in texts for w in t], pa.large_binary()).dictionary_encode()
            rank = np.empty(len(coded.dictionary), np.int32)
            rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank), dtype=np.int32)
            codes = rank[coded.indices.to_numpy()] if len(rank) else np.zeros(0, np.int32)
            if cycle:
                for k, (i, t) in enumerate(zip(ids, texts)):
                    if i is not None and t and (turn := cycle(i, len(t))):
                        a, p = turn
                        codes[starts[k] + a : starts[k + 1]] = np.resize(codes[starts[k] + a : starts[k] + a + p], len(t) - a)
                        texts[k] = t[:a] + (t[a : a + p] * (-(-(len(t) - a) // p)))[: len(t) - a]
            runs, texts_out = _find(codes, starts, least, times), []
            for t, found in zip(texts, runs):
                if found:
                    gone = np.zeros(len(t), bool)
                    for s, length, q in found:
                        gone[s + q : s + length] = True
                    t = [t[i] for i in np.flatnonzero(~gone).tolist()]
                texts_out.append(b" ".join(t))
            rows = [[{"start": s, "length": length, "period": q} for s, length, q in found] for found in runs]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(rows, out_type), pa.array(texts_out, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"]
            )

        ids, texts, held = [], [], 0
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("words").cast(pa.binary())):
                ids.append(i)
                texts.append(t.as_py().split())  # bytes are split at the six ASCII white-space characters alone
                held += len(texts[-1])
                if held >= CHUNK_WORDS:
                    yield flush(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield flush(ids, texts)

    return run


def detect(docs: DataFrame, least: int = 6, times: int = 4, cycle: Callable[[int, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """doc_id, runs (start, length, period in words, by start, then period) with length >= max(least, times * period), and collapsed: the text's words, less those
    that a run holds after its first period, joined by one space; times is 3 at least.

    cycle(doc_id, n_words) may give (a, p): the words from a on are then read as the p words from a on, over and over.
    """
    if times < 3:
        raise ValueError("times: 3 at least")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("words"))
    return rows.mapInArrow(_detector(least, times, cycle), _SCHEMA)


def planted(doc_id: int, n: int) -> tuple[int, int] | None:
    """Every tenth document, by the crc32 of its decimal id, repeats a stretch of itself to its end."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def op13(docs: DataFrame) -> DataFrame:
    found = detect(docs, cycle=planted).withColumn("best", F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))"))
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
