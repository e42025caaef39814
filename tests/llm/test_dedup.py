"""op5, op8 and op9 against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leadlake.llm import cells, exact_dedup, graph, line_dedup, simhash


def by_text(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    return groups


def check_op5(got, rows):
    groups = by_text(rows)
    assert len(got) == len(rows)
    for t, ids in groups.items():
        sha = hashlib.sha256(t.encode()).hexdigest()
        mine = [r for r in got if r.text_sha256 == sha]
        best = max((i for i in ids if i is not None), default=None)
        assert {r.keep_id for r in mine} == {best} and {r.group_size for r in mine} == {len(ids)}
        assert [r.doc_id for r in mine if r.kept] == [best]


def test_op5(odd, odd_rows):
    check_op5(exact_dedup.op5(odd).collect(), odd_rows)


def test_op5_verifies_bytes_when_digests_collide(odd, odd_rows):
    weak = lambda t: F.unhex(F.rpad(F.hex(F.length(t) % 3), 64, "0"))
    got = exact_dedup.index(odd, weak).collect()
    groups = by_text(odd_rows)
    want = defaultdict(int)
    for ids in groups.values():
        best = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, best, len(ids)] += 1
    have = defaultdict(int)
    for r in got:
        have[r.doc_id, r.keep_id, r.group_size] += 1
    assert have == want
    assert sum(r.kept for r in got) == len(groups)


@pytest.mark.parametrize("fan", [2, 3])
def test_op5_merges_level_by_level(spark, odd, odd_rows, monkeypatch, fan):
    """Each level holds each digest of a run once, in at most 1 / FAN of the runs before, and loses no row; look-ups find a text's entry in each."""
    monkeypatch.setattr(exact_dedup, "FAN", fan)
    docs = odd.repartition(11)
    got = sorted((str(r.doc_id), r.text_sha256, str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.op5(docs).collect())
    monkeypatch.setattr(exact_dedup, "FAN", 64)
    assert got == sorted((str(r.doc_id), r.text_sha256, str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.op5(docs).collect())
    monkeypatch.setattr(exact_dedup, "FAN", fan)
    log = docs.selectExpr("doc_id", "unhex(sha2(coalesce(text, ''), 256)) as digest", "spark_partition_id() as run", "monotonically_increasing_id() as pos")
    made = exact_dedup.levels(log.cache())
    runs = [t.select("run").distinct().count() for t in made]
    assert len(made) > 2 and runs[0] > fan and runs[-1] <= fan and all(b <= -(-a // fan) + 1 for a, b in zip(runs, runs[1:]))
    for t in made:
        assert t.count() == t.select("run", "digest").distinct().count() and t.agg({"n": "sum"}).first()[0] == len(odd_rows)
        assert exact_dedup.lookup(t, ["word"]).agg({"n": "sum"}).first()[0] == 1 and exact_dedup.lookup(t, ["nowhere"]).count() == 0


def test_op5_survivors_and_empty(odd, odd_rows, none):
    left = exact_dedup.survivors(odd)
    assert left.columns == odd.columns
    assert left.count() == len(by_text(odd_rows))
    assert exact_dedup.op5(none).collect() == [] and exact_dedup.survivors(none).collect() == []


def units(text):
    """Lines, and sentences in them: (start, end, least words)."""
    for rx, least in ((r"\n", 1), (r"[.!?][\x20\x09-\x0D]+|\n", 5)):
        at = 0
        for m in re.finditer(rx, text):
            yield at, m.end(), least
            at = m.end()
        if at < len(text):
            yield at, len(text), least


def test_op8(odd, odd_rows):
    seen = defaultdict(set)
    for i, t, *_ in odd_rows:
        t = t or ""
        for a, z, least in units(t):
            w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t[a:z]))
            if len(w) >= least:
                seen[" ".join(w)].add((i is not None, i or 0, t, a, z, len(w)))
    want = set()
    for places in seen.values():
        import zlib

        order = sorted(places, key=lambda p: (p[0], p[1], zlib.crc32(p[2].encode()), p[3]))
        first = order[0]
        want |= {(p[1] if p[0] else None, p[3], p[4], p[5], first[1] if first[0] else None, first[3]) for p in order[1:]}
    got = {tuple(r) for r in line_dedup.op8(odd).collect()}
    assert got == want and want


def test_op8_lines_of_short_sentences_and_of_few_words_go(spark):
    line = "One two. Three. Four five! Six? " * 9
    rows = [(1, f"a first line\n{line}\nAll rights reserved."), (2, f"another text here\nALL  rights reserved.\n{line}"), (3, f"start of three {line.strip()} and its end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in line_dedup.clean(docs).collect()}
    assert out[1] == rows[0][1] and out[2] == "another text here\n" and out[3] == rows[2][1]
    passage = "This is a sentence of a passage. It has another sentence of some words. "
    rows = [(1, f"Head one. {passage}Tail one."), (2, f"Head two is here. {passage}Tail two.")]
    out = {r.doc_id: r.text for r in line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: rows[0][1], 2: "Head two is here. Tail two."}


def test_op8_clean_and_empty(odd, none):
    out = line_dedup.clean(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert line_dedup.repeats(out).count() == 0
    assert line_dedup.op8(none).collect() == [] and line_dedup.clean(none).collect() == []
    for unit in ("line", "paragraph", "sentence"):
        assert line_dedup.repeats(line_dedup.clean(odd, (unit,)), (unit,)).count() == 0


def slow_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    a = np.array(fps, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 4) + i + 1:
            up[find(int(j))] = find(i)
    least = {}
    for k, i in enumerate(ids):
        r = find(k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [least.get(find(k)) for k in range(len(fps))]


def test_op9(odd, odd_rows):
    ids, fps = [r[0] for r in odd_rows], [slow_print(r[1] or "") for r in odd_rows]
    want = sorted(zip(map(str, ids), [f"{f:016x}" for f in fps], map(str, slow_components(ids, fps)), strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.op9(odd).collect()) == want
    assert simhash.survivors(odd).where("doc_id >= 40 and doc_id < 50").count() < 10


def test_op9_empty(none):
    assert simhash.op9(none).collect() == [] and simhash.survivors(none).collect() == []


@pytest.mark.parametrize(("deep", "side"), [(0, 8192), (0, 5), (1 << 22, 5)])
def test_large_buckets_in_cells_and_by_further_bits_lose_no_link(spark, monkeypatch, deep, side):
    """One bucket of many components: 1,500 prints that share 16 bits, pairs and chains among them; with small cells, with further keys, with both."""
    monkeypatch.setattr(simhash, "DEEP", deep)
    monkeypatch.setattr(cells, "SIDE", side)
    rng = random.Random(3)
    fps = set()
    for _ in range(600):
        x = rng.getrandbits(48) << 16 | 0xBEEF
        fps.add(x)
        for _ in range(rng.choice([0, 1, 3])):
            for b in rng.sample(range(16, 64), rng.randint(1, 5)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    bits = tuple(tuple(range(16 * i, 16 * i + 16)) for i in range(4))
    monkeypatch.setattr(simhash, "plan", lambda s, n, d=4: simhash.Plan(bits, (1, 0, 0, 0)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    comp = {r.v: r.comp for r in graph.components(edges).collect()}
    groups = lambda names: sorted(sorted(g) for g in _by(names))
    assert groups([comp.get(s, s) for s in signed]) == groups(slow_components(list(range(len(fps))), fps))


def _by(names):
    out = defaultdict(set)
    for i, c in enumerate(names):
        out[c].add(i)
    return out.values()


def test_cells_are_a_plain_join_and_bounded(spark, monkeypatch):
    """A hot key on both sides, null keys, a key of one side only: the join's rows; no cell holds more than a few times SIDE rows."""
    monkeypatch.setattr(cells, "SIDE", 20)
    key = lambda i: None if i % 50 == 0 else 0 if i % 3 else i % 7
    left = spark.createDataFrame([(key(i), i) for i in range(600)] + [(99, 1000)], "k long, a long")
    right = spark.createDataFrame([(key(i), i) for i in range(500)] + [(98, 2000)], "k long, b long")
    on = F.col("a") % 5 != F.col("b") % 5
    got = sorted(map(tuple, cells.meet(left, right, ["k"], ("a", "b"), on, "t").collect()))
    assert got == sorted(map(tuple, left.join(right, "k").where(on).collect())) and got
    none = left.limit(0)
    assert cells.meet(none, right, ["k"], ("a", "b"), on, "t").collect() == []


@pytest.mark.parametrize("limits", [None, (2, 1), (1, 2), (1, 1, 0), (2, 1, -1), (0, 0, 0, 0, 0)])
def test_links_join_dense_and_chained_fingerprints(spark, monkeypatch, limits):
    """A ball of close prints, a chain of steps of four bits, pairs at distances 4 and 5, zero; by the planned and by other thresholds."""
    if limits:
        made = simhash.plan
        monkeypatch.setattr(simhash, "plan", lambda s, n, d=4: simhash.Plan(simhash._grouped(s, len(limits)), limits))
        assert made is not simhash.plan
    rng = random.Random(2)
    fps, centre = {0}, rng.getrandbits(64)
    while len(fps) < 400:
        x = centre
        for b in rng.sample(range(64), rng.randint(0, 5)):
            x ^= 1 << b
        fps.add(x)
    x = rng.getrandbits(64)
    for k in range(12):
        fps.add(x)
        for b in range(4):
            x ^= 1 << (4 * k + b) % 64
    y = rng.getrandbits(64)
    fps |= {y, y ^ 0b11111, y ^ 0xF0000000}
    fps |= {rng.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    comp = {r.v: r.comp for r in graph.components(edges).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for i, (s, c) in enumerate(zip(signed, slow_components(list(range(len(fps))), fps), strict=True)):
        got[comp.get(s, s)].add(i)
        want[c].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_thresholds_cover_the_distance():
    rng = np.random.default_rng(0)
    for n in (10, 10_000, 10_000_000):
        p = simhash.plan(rng.integers(0, 1 << 63, 500, dtype=np.uint64), n)
        assert sorted(b for part in p.parts for b in part) == list(range(64))
        assert sum(p.limits) == simhash.DISTANCE + 1 - len(p.limits)
    few = simhash.plan(np.zeros(0, np.uint64), 0)
    assert sum(len(x) for x in few.parts) == 64
