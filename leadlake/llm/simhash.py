"""SimHash near-dedup by the generalised pigeonhole principle.

Equal fingerprints are one vertex. The 64 bits are grouped, correlated bits together, into m parts; part i gets a threshold t_i >= -1 (-1: not
probed) with sum(t_i) = 4 + 1 - m, so two fingerprints within 4 bits must lie within t_i bits in some part i. Number of parts and thresholds
come from dynamic programming over estimated candidate counts (from a bounded sample; the estimate moves cost, never results). Each
fingerprint stands in the bucket of its own key in every part, and probes the buckets of the keys within t_i bits; most probes of empty
buckets are dropped by a bitmap of all keys in use, of at most 2**BITMAP_BITS bits whatever the input, the others and lone rows by a count.

All pairs of a bucket are never written. First each row is compared with its bucket's least fingerprint; the components of these links
are found; then only rows outside their bucket's largest component are compared with the bucket's other components, which finds every link that
joins two components. No link is lost: a pair in one component is already joined, and of a pair in two components one row is outside the largest.
Buckets in which that would be many comparisons are parted again by the bits outside their part: these fall into DISTANCE + 1 groups, of which
linked rows agree wholly in one. What is still large is compared in cells of bounded size (cells.py).

Defined results: A-Z alone are lowered; no words gives fingerprint zero, linked like any other; null text is empty; null doc_id never names a
component; repeated rows share their component; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import accumulate, combinations, repeat
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.llm._common import body, boxed, cut, lean, number, tasks
from leadlake.llm.cells import meet
from leadlake.llm.graph import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
SAMPLE = 2048  # fingerprints looked at to estimate candidates
BITMAP_BITS = 27  # a part's bitmap has about 256 bits for each fingerprint, but no more than 2**27: 16 MB
#: What a row costs, in comparisons of two fingerprints: standing in a bucket, a probe made, one that passes the bitmap, one that meets a row.
OWN, MADE, PASSED, HIT = 5.0, 0.025, 2.0, 8.0
DEEP = 1 << 22  # comparisons from which on a bucket is parted by its other bits; it moves cost, never results
BLOCK_BYTES = 1 << 19  # text whose words stand in one list
_GAP = re.compile(rb"[\x20\x09-\x0D]").search
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _word_blocks(text: bytes, keep: int):
    """The words of text in blocks of about BLOCK_BYTES, so that no list holds all words of a long text; a block begins with the last `keep` words
    of the one before."""
    at, n, carried = 0, len(text), []
    while at < n:
        end = min(at + BLOCK_BYTES, n)
        if end < n:
            m = _GAP(text, end)
            end = m.start() if m else n
        words = carried + text[at:end].split()
        yield words
        carried = words[-keep:] if keep else []
        at = end


def shingle_hashes(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """XXH64 of each k-word shingle, repeats included; a text of fewer words is one shingle, a text without words none."""
    from xxhash import xxh64_intdigest

    out, few = [], []
    for words in _word_blocks(text.translate(_LOWER), k - 1):
        if len(words) < k:
            few = words
            continue
        whole = b" ".join(words)
        ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
        starts = [0, *(e + 1 for e in ends)]
        count = len(words) - k + 1
        out.append(np.fromiter(map(xxh64_intdigest, map(whole.__getitem__, map(slice, starts, ends[k - 1 :])), repeat(SEED)), np.uint64, count))
    if out:
        return out[0] if len(out) == 1 else np.concatenate(out)
    return np.array([xxh64_intdigest(b" ".join(few), SEED)] if few else [], np.uint64)


def _bits_set(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, bit 0 first."""
    if len(h) < 1024:
        return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    table = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    by = h.view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(by[:, i], minlength=256) @ table for i in range(8)])


def fingerprint(text: bytes) -> int:
    return fingerprint_of(shingle_hashes(text))


def fingerprint_of(h: np.ndarray) -> int:
    if not len(h):
        return 0
    on = 2 * _bits_set(h) > len(h)
    return int.from_bytes(np.packbits(on, bitorder="little").tobytes(), "little")


def _prints(batches):
    import pyarrow as pa

    lean()
    for b in batches:
        texts = b.column("text").cast(pa.large_string()).cast(pa.large_binary())
        fps = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    return rows.mapInArrow(_prints, "doc_id long, fp long")


@dataclass(frozen=True)
class Plan:
    parts: tuple[tuple[int, ...], ...]  # the bits of each part
    limits: tuple[int, ...]  # their thresholds


def _keys(fps: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(fps), np.int64)
    for i, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << i
    return out


def _grouped(sample: np.ndarray, m: int) -> tuple[tuple[int, ...], ...]:
    """Bits in m parts of equal width; each part starts with the least free bit and takes the bits most correlated with those it has."""
    on = (sample[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(np.float64)
    on -= on.mean(axis=0) if len(on) else 0
    norm = np.sqrt((on**2).sum(axis=0))
    cor = np.abs(on.T @ on) / np.maximum(np.outer(norm, norm), 1e-9)
    free, out = list(range(64)), []
    for i in range(m):
        width = 64 // m + (i < 64 % m)
        part = [free.pop(0)]
        while len(part) < width:
            best = max(free, key=lambda b: (cor[b, part].sum(), -b))
            free.remove(best)
            part.append(best)
        out.append(tuple(sorted(part)))
    return tuple(out)


def plan(sample: np.ndarray, rows: int, distance: int = DISTANCE) -> Plan:
    """The cheapest parts and thresholds for this many fingerprints, by estimated probes and candidates."""
    best = None
    for m in (2, 3, 4, 5):
        groups = _grouped(sample, m)
        table = []
        for bits in groups:
            w = len(bits)
            k = _keys(sample, bits)
            d = np.bitwise_count(k[:, None] ^ k[None, :])
            seen = np.bincount(d.ravel(), minlength=w + 1).astype(float)
            seen[0] -= len(k)
            pairs = max(1, len(k) * (len(k) - 1))
            cost = {-1: 0.0}
            for t in range(distance + 2 - m + m):
                keys = sum(comb(w, j) for j in range(t + 1))
                share = max(seen[: t + 1].sum() / pairs, keys / 2.0**w)
                hits, passes = min(1.0, rows / 2.0**w), min(1.0, rows / 2.0 ** _map_bits(w, rows))
                cost[t] = rows * (OWN + keys * (MADE + PASSED * passes + HIT * hits)) + rows * rows / 2 * share
            table.append(cost)
        # least cost of the first parts for each sum of thresholds
        state = {0: (0.0, ())}
        for cost in table:
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for s, (c, chosen) in state.items():
                for t, x in cost.items():
                    if s + t not in step or c + x < step[s + t][0]:
                        step[s + t] = (c + x, (*chosen, t))
            state = step
        total, limits = state[distance + 1 - m]
        if best is None or total < best[0]:
            best = (total, Plan(groups, limits))
    return best[1]


def _map_bits(width: int, rows: int) -> int:
    return min(width, BITMAP_BITS, max(22, (256 * rows).bit_length()))


def _bitmaps(fps: DataFrame, p: Plan, rows: int) -> dict[int, tuple[int, bytes]]:
    """For each probed part its bitmap of the keys in use, wide keys folded, built by native aggregation."""
    out = {}
    for i, (bits, t) in enumerate(zip(p.parts, p.limits, strict=True)):
        if t < 1:
            continue
        size = _map_bits(len(bits), rows)
        key = F.lit(0).cast("long")
        for j, b in enumerate(bits):  # bits past the bitmap's width fold onto two others each, so no one or two flips leave the place as it was
            for place in [j] if j < size else [j - size, j - size + size // 2]:
                key = key.bitwiseXOR(F.shiftleft(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1)), place))
        k = fps.select((key + 1).alias("k"))
        got = k.groupBy(F.bitmap_bucket_number("k").alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("k")).alias("bits")).collect()
        whole = np.zeros(max(4096, (1 << size) // 8), np.uint8)
        for r in got:
            whole[(r.n - 1) * 4096 : r.n * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
        out[i] = (size, whole.tobytes())
    return out


def _signer(p: Plan, maps: dict[int, tuple[int, bytes]]):
    def run(batches):
        import pyarrow as pa

        used = {i: (size, np.frombuffer(m, np.uint8)) for i, (size, m) in maps.items()}
        masks = {
            i: np.array([sum(1 << j for j in c) for n in range(1, t + 1) for c in combinations(range(len(bits)), n)], np.int64)
            for i, (bits, t) in enumerate(zip(p.parts, p.limits, strict=True)) if t >= 1
        }

        def rows(i, keys, fps, probe):
            n = len(keys)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, i, np.int8)), pa.array(keys), pa.array(fps), pa.array(np.full(n, probe, bool))], names=["part", "key", "fp", "probe"])

        for b in batches:
            all_ = b.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(all_), 1000):
                fps = all_[at : at + 1000]
                for i, (bits, t) in enumerate(zip(p.parts, p.limits, strict=True)):
                    if t < 0:
                        continue
                    keys = _keys(fps.view(np.uint64), bits)
                    yield rows(i, keys, fps, False)
                    if t:
                        near = (keys[:, None] ^ masks[i][None, :]).ravel()
                        whose = np.repeat(fps, len(masks[i]))
                        size, bitmap = used[i]
                        over = near >> size
                        at_bit = near & ((1 << size) - 1) ^ over ^ over << size // 2
                        live = (bitmap[at_bit >> 3] >> (at_bit & 7).astype(np.uint8) & 1).astype(bool)
                        near, whose = near[live], whose[live]
                        yield rows(i, near, whose, True)

    return run


def _deeper(p: Plan, distance: int) -> Column:
    """The further keys of a row (part, fp): hashes of distance + 1 groups of the bits outside its part. Linked rows share one of them at least."""
    masks = []
    for bits in p.parts:
        rest = [b for b in range(64) if b not in bits]
        groups = [sum(1 << b for b in rest[j :: distance + 1]) for j in range(distance + 1)]
        masks.append(F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in groups]))
    own = F.element_at(F.array(*masks), F.col("part").cast("int") + 1)
    return F.transform(own, lambda m, j: F.xxhash64(j, F.col("fp").bitwiseAND(m)))


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """fps (fp), distinct -> (a, b): links of at most distance bits that join all fingerprints that any such links join."""
    sample = np.array([r.fp for r in fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    rows = fps.count()
    p = plan(sample, rows, distance)
    signed = cut(fps.select("fp").mapInArrow(_signer(p, _bitmaps(fps, p, rows)), "part byte, key long, fp long, probe boolean"), "simhash-keys")
    close = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance
    bucket = ["part", "key"]
    heads = signed.groupBy(*bucket).agg(F.min(F.when(~F.col("probe"), F.col("fp"))).alias("head"), F.count(F.lit(1)).alias("n")).where("head is not null and n > 1").drop("n")
    n = tasks(signed)
    live = cut(signed.join(heads, bucket), "simhash-live", n)
    star = cut(live.where(F.col("fp") != F.col("head")).where(close("fp", "head")).select(F.col("fp").alias("a"), F.col("head").alias("b")), "simhash-star", n)
    comp = components(star, "simhash-cc").withColumnRenamed("v", "fp")
    labelled = cut(live.drop("head").join(comp, "fp", "left").withColumn("comp", F.coalesce("comp", "fp")), "simhash-labelled", n)
    sizes = labelled.groupBy(*bucket, "comp").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("probe")).alias("own"))
    mixed = sizes.groupBy(*bucket).agg(F.count(F.lit(1)).alias("comps"), F.sum("own").alias("own"), F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("most"))
    made = (F.col("n") - F.col("most.n")).cast("double") * F.col("n")
    mixed = cut(mixed.where("comps > 1 and own > 0").select(*bucket, F.col("most.comp").alias("main"), (made > DEEP).alias("deep")), "simhash-mixed", n)
    at = labelled.join(mixed, bucket).withColumn("sub", F.explode(F.when(F.col("deep"), _deeper(p, distance)).otherwise(F.array(F.lit(0).cast("long")))))
    at = cut(at.select(*bucket, "sub", "fp", "comp", "probe", "main"), "simhash-open", n)
    left = at.where("comp <> main").select(*bucket, "sub", F.col("fp").alias("a"), F.col("comp").alias("ca"), F.col("probe").alias("pa"))
    right = at.select(*bucket, "sub", F.col("fp").alias("b"), F.col("comp").alias("cb"), F.col("probe").alias("pb"))
    on = (F.col("ca") != F.col("cb")) & ~(F.col("pa") & F.col("pb")) & close("a", "b")
    cross = cut(meet(left, right, [*bucket, "sub"], ("a", "b"), on, "simhash", n).select("a", "b"), "simhash-cross", n)
    return star.unionByName(cross)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for each row of docs."""
    prints = cut(fingerprints(docs), "simhash-prints")
    n = tasks(prints)
    fps = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct", n)
    comp = components(links(fps), "simhash-all").withColumnRenamed("v", "fp")
    named = fps.join(comp, "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    named = cut(named, "simhash-named", n)
    least = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    return prints.join(cut(named.join(least, "comp").select("fp", "component_id"), "simhash-components", n), "fp")


def survivors(docs: DataFrame) -> DataFrame:
    """One document of each group stays: the one with the least doc_id. Rows that share a doc_id share its fate; rows without one stay."""
    found = near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"))
    gone = cut(found.where("not stays").select(F.col("doc_id").alias("id")), "simhash-gone", tasks(docs))
    return boxed(docs, id=number()).join(gone, "id", "left_anti").select("row.*")


def op9(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
