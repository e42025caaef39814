"""Near-dedup by SimHash and exact resemblance: every pair of documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more is linked.

First come the links of SimHash fingerprints of the same shingles by the pigeonhole principle (simhash.py), those whose whole sets are similar. They join
components before anything else is compared; texts of 0.8 similarity often differ in more bits, and these are found as follows.

Candidates come from prefixes, which lose nothing: in any one order of all shingles, two sets of similarity s share one of the first
n - ceil(s * n) + 1 shingles of each (n its size). The order puts shingles that are common in a bounded sample last, so that boilerplate seldom
stands in a prefix; the sample moves cost, never results. A candidate goes only by bounds that no linked pair breaks: what is left of both sets
after the shared shingle, and the differing bits of two parity maps, which are at most the differing shingles. The others are counted exactly.

Equal sets are one vertex. Buckets of a few rows are compared whole. Of the others, each that holds more than one component compares its rows with
one of them, drawn by a hash of bucket, row and turn, so that a document meets as many others as it has buckets, and the links found join
components. Once few pairs are left, or a turn has joined little, rows outside their bucket's largest component are compared with its other components, which finds every link that joins two
components, large buckets in cells of bounded size (cells.py). The bounds stand in the joins' conditions: a join writes only pairs that may be linked.

Defined results: A-Z alone are lowered; a text of fewer words than a shingle is one shingle, no words one empty shingle; null text is empty;
null doc_id never names a component; repeated rows share their component; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.llm import simhash
from leadlake.llm._common import bitmap, body, boxed, cut, lean, maybe_in, number, tasks
from leadlake.llm.cells import meet
from leadlake.llm.graph import components
from leadlake.llm.simhash import SEED, shingle_hashes

SHINGLE = 5
P, Q = 4, 5  # linked from a similarity of P / Q on
SAMPLE = 16384  # documents looked at, about, to find common shingles
COMMON = 1 << 17  # common shingles known, at most
_MAPS = ["m0", "m1", "m2", "m3"]  # the parity map of 256 bits, tried first
WIDE = 4096  # bits of the parity map tried then, for long texts
SMALL = 6  # buckets of at most so many rows are compared whole at once, larger ones by turns
BEFORE = 4  # so many shingles before one in a prefix tell that a pair has met already
FEW = 2  # all components are compared once that makes no more than so many pairs a row,
GAIN = 0.7  # or once a turn has left more than this share of the pairs; both move cost, never results


def shingle_set(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes in ascending order; never empty."""
    from xxhash import xxh64_intdigest

    return _set(shingle_hashes(text, k))


def _set(h: np.ndarray) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.unique(h if len(h) else np.array([xxh64_intdigest(b"", SEED)], np.uint64))


def _vertex(s: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(s.tobytes(), SEED)


def _prefixes(common: np.ndarray, times: np.ndarray):
    """common: shingles in ascending order, times: how often each was met."""

    def run(batches):
        import pyarrow as pa

        lean()
        for b in batches:
            fps, sims, sizes, maps, wides, firsts = [], [], [], [], [], []
            for t in b.column("text").cast(pa.large_string()).cast(pa.large_binary()):
                h = shingle_hashes(t.as_py(), SHINGLE)
                s = _set(h)
                sims.append(simhash.fingerprint_of(h))
                n = len(s)
                fps.append(_vertex(s))
                sizes.append(n)
                wide = (np.bincount((s & np.uint64(WIDE - 1)).astype(np.int64), minlength=WIDE) & 1).astype(np.uint8)
                wides.append(np.packbits(wide, bitorder="little").view("<i8"))
                maps.append(np.packbits(np.bitwise_xor.reduce(wide.reshape(-1, 256)), bitorder="little").view("<i8"))
                ordered = s
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    met = np.where(common[at] == s, times[at], 0)
                    ordered = s[np.argsort(met, kind="stable")]
                firsts.append(ordered[: n - -(-P * n // Q) + 1].view("<i8"))
            four = np.array(maps, np.int64).reshape(-1, 4)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in firsts])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts) if firsts else np.zeros(0, np.int64)))
            broad = pa.ListArray.from_arrays(pa.array(np.arange(0, len(wides) + 1, dtype=np.int32) * (WIDE // 64)), pa.array(np.concatenate(wides) if wides else np.zeros(0, np.int64)))
            cols = [b.column("doc_id"), b.column("text_hash"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(np.array(sims, np.uint64).view(np.int64)), pa.array(np.array(sizes, np.int32)), *(pa.array(np.ascontiguousarray(four[:, i])) for i in range(4)), broad, lists]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "fp", "sim", "n", *_MAPS, "wide", "prefix"])

    return run


def _whole(batches):
    import pyarrow as pa

    lean()
    for b in batches:
        sets = [shingle_set(t.as_py()) for t in b.column("text").cast(pa.large_string()).cast(pa.large_binary())]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view("<i8") if sets else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(np.array([_vertex(s) for s in sets], np.uint64).view(np.int64)), lists], names=["fp", "shingles"])


def _common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that three or more documents of a sample of bounded size hold."""
    some = rows.where(F.pmod(F.xxhash64("text_hash", F.monotonically_increasing_id()), F.lit(max(1, rows.count() // SAMPLE))) == 0)
    each = some.select("text").mapInArrow(_whole, "fp long, shingles array<long>").select(F.explode("shingles").alias("h"))
    got = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.col("n").desc(), "h").limit(COMMON).toPandas()
    h = got["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], got["n"].to_numpy(np.int64)[order]


def _can(differ: Column, both: Column) -> Column:
    """Whether sets of `both` shingles together can be similar if they differ in at least `differ`."""
    return (P + Q) * (both - differ) >= 2 * P * both


def _may(x: Column, y: Column) -> Column:
    """Whether the rows x and y of one bucket can be linked: no linked pair fails it at the first shingle that both prefixes hold."""
    left = F.least(x["n"] - x["pos"], y["n"] - y["pos"])
    both = x["n"] + y["n"]
    differ = sum((F.bit_count(x[m].bitwiseXOR(y[m])) for m in _MAPS), F.lit(0))
    return (x["fp"] != y["fp"]) & ((P + Q) * left >= P * both) & _can(differ, both)


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x["fp"], y["fp"]).alias("a"), F.greatest(x["fp"], y["fp"]).alias("b")]


class _Checker:
    """Finds which candidate pairs (a, b) have similar whole sets. Only texts of candidates are cut into shingles again, each once."""

    def __init__(self, rows: DataFrame, prints: DataFrame):
        self.rows, self.prints, self.sets = rows, prints, None

    def links(self, pairs: DataFrame, name: str, files: int) -> DataFrame:
        links, sets = self._links(pairs, name, files)
        self.sets = sets if self.sets is None else self.sets.unionByName(sets)
        return links

    def _links(self, pairs: DataFrame, name: str, files: int) -> tuple[DataFrame, DataFrame]:
        pairs = cut(pairs.distinct(), f"{name}-pairs", files)
        n = tasks(pairs)
        wide = self.prints.select("fp", F.struct("n", "wide").alias("x")).join(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct(), "fp", "left_semi").dropDuplicates(["fp"])
        both = pairs.join(wide.withColumnRenamed("fp", "a"), "a").join(wide.select(F.col("fp").alias("b"), F.col("x").alias("y")), "b")
        differ = F.aggregate(F.zip_with("x.wide", "y.wide", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
        pairs = cut(both.where(_can(differ, F.col("x.n") + F.col("y.n"))).select("a", "b"), f"{name}-likely", n)

        need = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
        if self.sets is not None:
            need = need.join(self.sets.select("fp"), "fp", "left_anti")
        need = cut(need, f"{name}-need", n)
        texts = cut(self.prints.select("fp", "text_hash").join(need, "fp", "left_semi").groupBy("fp").agg(F.min("text_hash").alias("text_hash")), f"{name}-texts", n)
        some = maybe_in(self.rows.select("text_hash", "text"), "text_hash", bitmap(texts, "text_hash")).join(texts.select("text_hash").distinct(), "text_hash", "left_semi")
        sets = cut(some.select("text").mapInArrow(_whole, "fp long, shingles array<long>").join(need, "fp", "left_semi").dropDuplicates(["fp"]), f"{name}-sets", tasks(need, 10_000))
        known = sets if self.sets is None else self.sets.unionByName(sets)
        on = lambda c: known.select(F.col("fp").alias(c), F.col("shingles").alias(f"s{c}"))
        shared = F.size(F.array_intersect("sa", "sb"))
        links = pairs.join(on("a"), "a").join(on("b"), "b").where((P + Q) * shared >= P * (F.size("sa") + F.size("sb"))).select("a", "b")
        return cut(links, f"{name}-links", n), sets


def _mixed(labelled: DataFrame) -> DataFrame:
    """Buckets of more than one component: key, the largest component, pairs (as a double) that a comparison of all components would make."""
    sizes = labelled.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    by = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("most"))
    return by.where("comps > 1").select("key", F.col("most.comp").alias("main"), ((F.col("n") - F.col("most.n")) * F.col("n").cast("double")).alias("pairs"))


def _against_one(at: DataFrame, turn: int) -> DataFrame:
    """Of each bucket of `at` (key, x, comp) one row, another one in every bucket and turn, is compared with all that are not in its component."""
    drawn = at.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "x.fp", F.lit(turn)), F.col("x"), "comp")).alias("p")).select("key", F.col("p.x").alias("y"), F.col("p.comp").alias("cy"))
    met = at.join(drawn, (at["key"] == drawn["key"]) & (F.col("comp") != F.col("cy")) & _may(F.col("x"), F.col("y")))
    return met.select(*_pair(F.col("x"), F.col("y")))


def _one_each(prints: DataFrame, fps: DataFrame) -> DataFrame:
    """One row of prints for each fp: only rows whose fp comes again travel."""
    again = bitmap(fps.where("rows > 1"), "fp")
    cols = ["fp", "n", *_MAPS, "prefix"]
    return maybe_in(prints, "fp", again, False).select(*cols).unionByName(maybe_in(prints, "fp", again).select(*cols).dropDuplicates(["fp"]))


def _by_simhash(prints: DataFrame, n: int) -> DataFrame:
    """Pairs of vertices that SimHash links: of each fingerprint all with the least one, and the least ones of linked fingerprints."""
    marks = cut(prints.groupBy("fp").agg(F.min("sim").alias("sim")), "near-marks", n)
    heads = cut(marks.groupBy("sim").agg(F.min("fp").alias("head")), "near-heads", n)
    equal = marks.join(heads, "sim").where("fp <> head").select(F.col("head").alias("a"), F.col("fp").alias("b"))
    head = lambda c: heads.select(F.col("sim").alias(c), F.struct(F.col("head").alias("fp")).alias(f"h{c}"))
    linked = simhash.links(heads.select(F.col("sim").alias("fp"))).select("a", "b").join(head("a"), "a").join(head("b"), "b").where("a <> b")
    return equal.unionByName(linked.select(*_pair(F.col("ha"), F.col("hb"))))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the vertex of its set), component_id for each row of docs."""
    rows = docs.select(number().alias("doc_id"), body().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    schema = f"doc_id long, text_hash long, fp long, sim long, n int, {', '.join(f'{m} long' for m in _MAPS)}, wide array<long>, prefix array<long>"
    prints = cut(rows.select("doc_id", "text_hash", "text").mapInArrow(_prefixes(*_common(rows)), schema), "near-prints")
    fps = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "near-distinct", tasks(prints))
    check = _Checker(rows, prints)
    first = check.links(_by_simhash(prints, tasks(prints)), "near-simhash", tasks(prints))
    comp = components(first, "near-cc-simhash")

    one = _one_each(prints, fps)
    shared = cut(one.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "near-shared", tasks(prints, 20_000))
    placed = one.select("fp", "n", *_MAPS, "prefix", F.posexplode("prefix").alias("pos", "key"))
    x = F.struct("fp", "n", "pos", *_MAPS).alias("x")
    before = F.slice("prefix", F.greatest(F.col("pos") - (BEFORE - 1), F.lit(1)), F.least(F.col("pos"), F.lit(BEFORE))).alias("before")

    def held(some: DataFrame, *cols) -> DataFrame:
        return maybe_in(placed.select("key", *cols), "key", bitmap(some, "key")).join(some.select("key"), "key")

    # small buckets are compared whole at once
    few = held(shared.where(f"rows <= {SMALL}"), x).groupBy("key").agg(F.collect_list("x").alias("xs"))
    each = F.flatten(F.transform("xs", lambda x, i: F.transform(F.slice("xs", i + 2, F.lit(SMALL)), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    met = few.select(F.explode(F.filter(each, lambda p: _may(p["x"], p["y"]))).alias("p")).select(*_pair(F.col("p.x"), F.col("p.y")))
    # large ones by turns
    wide = tasks(shared, 50_000)
    live = cut(held(shared.where(f"rows > {SMALL}"), x, before), "near-live", wide)
    total = live.count()
    n = tasks(live)
    at = live.join(comp, live["x.fp"] == comp["v"], "left").select("key", "x", F.coalesce("comp", "x.fp").alias("comp"))
    found = check.links(met.unionByName(_against_one(at, 0)).join(first, ["a", "b"], "left_anti"), "near-turn-0", wide).unionByName(first)
    comp = components(found, "near-cc-0")
    pairs_before = float("inf")
    for turn in count(1):
        at = live.join(comp, live["x.fp"] == comp["v"], "left").select("key", "x", "before", F.coalesce("comp", "x.fp").alias("comp"))
        at = cut(at, f"near-labelled-{turn}", n)
        mixed = cut(_mixed(at), f"near-mixed-{turn}", n)
        pairs = mixed.agg(F.sum("pairs")).first()[0] or 0
        if pairs <= FEW * total or pairs > GAIN * pairs_before:
            break
        pairs_before = pairs
        found = found.unionByName(check.links(_against_one(at, turn), f"near-turn-{turn}", n))
        comp = components(found, f"near-cc-{turn}")

    outside = mixed.select(F.col("key").alias("k"), "main")
    left = at.join(outside, (F.col("key") == F.col("k")) & (F.col("comp") != F.col("main"))).select("key", "x", F.col("before").alias("bx"), F.col("comp").alias("cx"), "main", F.col("x.fp").alias("fx"))
    right = at.select("key", F.col("x").alias("y"), F.col("before").alias("by"), F.col("comp").alias("cy"), F.col("x.fp").alias("fy"))
    # of two rows outside the main component each pair comes once; a pair that met at a key just before has been seen there
    once = ((F.col("cy") == F.col("main")) | (F.col("cx") < F.col("cy"))) & ~F.arrays_overlap("bx", "by")
    left = cut(left, "near-outside", n)
    right = right.join(outside.select(F.col("k").alias("key")), "key", "left_semi")
    cross = meet(left, right, ["key"], ("fx", "fy"), (F.col("cx") != F.col("cy")) & _may(F.col("x"), F.col("y")) & once, "near", n)
    cross = check.links(cross.select(*_pair(F.col("x"), F.col("y"))), "near-cross", n)

    comp = components(found.unionByName(cross), "near-all").withColumnRenamed("v", "fp")
    n = tasks(fps)
    named = cut(fps.join(comp, "fp", "left").withColumn("comp", F.coalesce("comp", "fp")), "near-named", n)
    least = named.groupBy("comp").agg(F.min("first").alias("component_id"))
    return prints.select("doc_id", "fp").join(cut(named.join(least, "comp").select("fp", "component_id"), "near-components", n), "fp")


def survivors(docs: DataFrame) -> DataFrame:
    """One document of each group stays: the one with the least doc_id. Rows that share a doc_id share its fate; rows without one stay."""
    found = near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"))
    gone = cut(found.where("not stays").select(F.col("doc_id").alias("id")), "near-gone", tasks(docs))
    return boxed(docs, id=number()).join(gone, "id", "left_anti").select("row.*")
