"""Operators 11 to 13 against brute force."""

import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leadlake.llm import imatch, runs, whitening

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


# --- op13 ---


def _brute_runs(w, least=6, times=4):
    """By the definition: for each period its maximal stretches, less those that have a smaller one."""
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(least, times * q) and not any(all(w[k] == w[k + p] for k in range(s, s + length - p)) for p in range(1, q)):
                out.append((s, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def _brute_op13(doc_id, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and n and h % 10 == 0:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = _brute_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    milli = 1000 * best[1] // best[2] if found else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, milli, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.mark.parametrize("seed", range(4))
def test_all_runs_of_small_alphabets(seed):
    rng = random.Random(seed)
    for _ in range(400):
        n, k = rng.randint(0, 45), rng.randint(1, 4)
        w = [rng.randrange(k) for _ in range(n)]
        if n > 3 and rng.random() < 0.4:
            w = (w[: rng.randint(1, n)] * n)[:n]
        assert sorted(runs.all_runs(w)) == sorted(_brute_runs(w, 2, 2))
        assert runs._find(np.array(w, np.int32), np.array([0, n]), 6, 4)[0] == _brute_runs(w)


def test_lyndon_arrays_take_linear_time():
    """Symbols compared, on texts that make plain comparison quadratic."""

    class Counted(int):
        seen = 0

        def __eq__(self, other):
            Counted.seen += 1
            return int(self) == int(other)

        def __ne__(self, other):
            Counted.seen += 1
            return int(self) != int(other)

        __hash__ = int.__hash__

    fib = [[0], [0, 1]]
    while len(fib[-1]) < 4000:
        fib.append(fib[-1] + fib[-2])
    for w in ([0] * 4000, [0, 1] * 2000, [1, 0] * 2000, fib[-1][:4000], list(range(40)) * 100, [x for k in range(88) for x in [0] * k + [1]]):
        Counted.seen = 0
        runs.lyndon([Counted(x) for x in w])
        assert Counted.seen < 8 * len(w)


def test_op13_against_brute_force(spark, odd, odd_rows):
    rng = random.Random(3)
    more = [(1000 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    more += [(2000, "x " * 500), (2001, "a b c " * 9 + "a b"), (2002, None), (2003, "one\x85two\xa0three\x1cfour " * 5)]
    docs = odd.select("doc_id", "text").where(F.length(F.coalesce("text", F.lit(""))) < 5000).unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = [_brute_op13(r.doc_id, r.text) for r in docs.collect()]
    got = [tuple(r) for r in runs.op13(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 0 for r in got) > 30


def test_runs_of_other_bounds_empty_tables_and_clashing_names(spark, odd, none):
    assert runs.op13(none).count() == 0
    assert runs.op13(odd.withColumn("words", F.lit(1)).withColumn("runs", F.lit(2))).count() == odd.count()
    one = spark.createDataFrame([(1, "a b a b a b c")], "doc_id long, text string")
    assert [tuple(r) for r in runs.detect(one, least=4, times=3).head().runs] == [(0, 6, 2)]
    assert runs.detect(one, least=4, times=3).head().collapsed == "a b c"
    with pytest.raises(ValueError):
        runs.detect(one, times=2)


def test_chunks_of_words_give_the_same(spark, odd, monkeypatch):
    whole = sorted(map(tuple, runs.op13(odd).collect()), key=repr)
    monkeypatch.setattr(runs, "CHUNK_WORDS", 50)
    docs = [(r.doc_id, (r.text or "").encode()) for r in odd.collect()]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs], pa.int64()), pa.array([d[1].decode() for d in docs])], names=["doc_id", "words"])
    got = [x for b in runs._detector(6, 4, runs.planted)([batch]) for x in b.to_pylist()]
    assert sorted((x["doc_id"], len(x["runs"])) for x in got if x["doc_id"] is not None) == sorted((x[0], x[1]) for x in whole if x[0] is not None)


# --- op12 ---


def _table(spark, rows, parts=7):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string").repartition(parts)


def _expected(vectors, most=32):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    return ((n * x - s) ** 2).sum(axis=1), c @ u[:, :most] / np.sqrt(e[:most]), e[:most] / e.sum()


@pytest.mark.parametrize("dims", [5, 40])
def test_whitening_against_eigenvectors(spark, dims, monkeypatch):
    monkeypatch.setattr(whitening, "MERGE", 2)  # several levels
    rng = np.random.default_rng(dims)
    vectors = rng.normal(size=(300, dims)) * np.linspace(1, 9, dims) + 3
    rows = [(i, v.tolist(), "a") for i, v in enumerate(vectors)]
    rows += [(900, None, "a"), (901, [1.0, None] + [0.0] * (dims - 2), "a"), (902, [float("nan")] * dims, "a"), (903, [float("inf")] * dims, "a"), (904, [], "a"), (905, [1.0], None)]
    out = whitening.op12(_table(spark, rows)).orderBy("vec_id", "component").toPandas()
    dev, white, share = _expected(vectors)
    k = min(32, dims)
    assert len(out) == 300 * k and set(out.vec_id) == set(range(300)) and set(out.component) == set(range(1, k + 1))
    assert (out.deviation.to_numpy().reshape(300, k) == dev[:, None]).all() and (out.n == 300).all()
    got = out.whitened.to_numpy().reshape(300, k)
    signs = np.sign((got * white).sum(axis=0))
    assert np.abs(got * signs - white).max() < 1e-6
    assert np.abs(out.explained.to_numpy()[:k] - share).max() < 1e-9
    assert out.identity_error.nunique() == 1 and 0 <= out.identity_error[0] < 1e-9


def test_states_merge_losslessly():
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(500, 12)) * 1000).astype(np.int64) + 10**6
    parts = [whitening.State.of(p) for p in np.split(x, [1, 2, 7, 19, 300])]
    total = parts[0]
    for p in parts[1:]:
        total = whitening.State.read(total.merge(p).row())
    c = x - x.mean(axis=0)
    assert total.n == 500 and total.sums == x.sum(axis=0).tolist()
    assert np.allclose(total.values, np.linalg.svd(c, compute_uv=False), rtol=1e-10)
    assert np.allclose((total.vectors.T * total.values**2) @ total.vectors, c.T @ c, rtol=1e-9, atol=1e-3)


def test_whitening_of_edge_tables(spark):
    empty = whitening.op12(_table(spark, [(1, None, "a")]))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    one = whitening.op12(_table(spark, [(1, [1.0, 2.0], "a")])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened) for r in sorted(one, key=lambda r: r.component)] == [(1, 1, 0, None), (2, 1, 0, None)]
    # one direction only; repeated rows and null ids count; a huge entry is bounded
    flat = whitening.op12(_table(spark, [(None, [float(i % 4), 0.0], "a") for i in range(40)] + [(7, [3.0, 0.0], "a")] * 2)).collect()
    assert len(flat) == 84 and all((r.whitened is None) == (r.component == 2) for r in flat) and flat[0].identity_error < 1e-9
    big = whitening.op12(_table(spark, [(i, [3e38 if i == 3 else float(i), float(i * i)], "a") for i in range(20)])).collect()
    assert all(r.deviation is None for r in big) and len(big) == 40


# --- op11 ---


def _h(data: bytes, seed=42):
    return xxhash.xxh64(data, seed=seed).intdigest()


def _long_hash(values):
    h = 42
    for v in values:
        h = xxhash.xxh64(struct.pack("<Q", v & (2**64 - 1)), seed=h).intdigest()
    return h


def _signed(v):
    return v - 2**64 if v >= 2**63 else v


def _terms(text):
    return {_signed(_h(t.encode())) for t in re.split(r"[^\w]+|_", text.lower()) if t}


def _brute_prints(texts):
    n, df = len(texts), {}
    mask = (1 << imatch.SLOT_BITS) - 1
    for t in texts:
        for p in {x & mask for x in _terms(t)}:
            df[p] = df.get(p, 0) + 1
    inside = {p for p, c in df.items() if imatch.LOW <= math.log(n / c) < imatch.HIGH}

    def slot(xs):
        return f"{_long_hash(xs) & (16**imatch.WIDTH - 1):0{imatch.WIDTH}x}" if xs else "-" * imatch.WIDTH

    def mark(text):
        own = sorted(x for x in _terms(text) if x & mask in inside)
        out = slot(own) if own else slot([_h(text.encode())])
        for xs in (own, [_long_hash([x]) for x in own]):
            for c in range(imatch.CHAINS // 2):
                at = imatch.BIT + c * (imatch.FIRST + imatch.LEVELS - 1)
                for level in range(imatch.LEVELS):
                    low = ((1 << imatch.FIRST + level) - 1) << at
                    out += slot([x for x in xs if x & low == 0])
        return out

    return mark


def _like(a, b):
    pairs = [(a[i : i + imatch.WIDTH], b[i : i + imatch.WIDTH]) for i in range(0, len(a), imatch.WIDTH)]
    filled = [p for p in pairs if p != ("-" * imatch.WIDTH,) * 2]
    return sum(x == y for x, y in filled) / len(filled)


def test_op11_against_brute_force(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("aeéßstr") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    rows = [(i * 3, " ".join(rng.choice(words) + rng.choice(["", ".", ",", "\n"]) for _ in range(rng.randint(0, 90)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, rows[5][1]), (1003, rows[5][1]), (1004, "??? !!"), (1005, "Ünïque1 wörds2 ონლი"), (-7, "the last one")]
    got = {r.doc_id: r for r in imatch.op11(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    mark = _brute_prints([t or "" for _, t in rows])
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        n = len(text)
        other = text[: n - n // 2] + following[: n // 2]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(other.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (mark(text), mark(other))
        assert r.near_edited == pytest.approx(_like(mark(text), mark(other))) and r.near_next == pytest.approx(_like(mark(text), mark(following)))
    assert got[1002].fingerprint == got[1003].fingerprint and got[1003].near_next == 1


def test_op11_on_odd_rows(spark, odd, none):
    assert imatch.op11(none).count() == 0
    out = imatch.op11(odd).collect()
    assert len(out) == odd.count()
    assert len({(r.doc_id, r.fingerprint) for r in out if r.doc_id == 30}) == 1  # a repeated row
    for r in out:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == imatch.SLOTS * imatch.WIDTH
    alone = imatch.op11(spark.createDataFrame([(5, "ab cd ef gh")], "doc_id long, text string")).head()
    assert alone.near_next == 1 and alone.edited_sha256 == hashlib.sha256(b"ab cd ab cd"[:6] + b"ab cd").hexdigest()


def test_changed_words_keep_part_of_the_fingerprint(spark):
    rng = random.Random(2)
    words = ["w%d" % i for i in range(4000)]
    rows = [(2 * i, " ".join(rng.choice(words) for _ in range(300))) for i in range(200)]
    near = [(2 * i + 1, " ".join(w if k % 60 else "changed" for k, w in enumerate(t.split()))) for (_, t), i in zip(rows[:50], range(50))]
    out = {r.doc_id: r.near_next for r in imatch.op11(spark.createDataFrame(rows + near, "doc_id long, text string")).collect()}
    changed, others = [out[2 * i + 1] for i in range(50)], [out[2 * i] for i in range(60, 200)]
    assert min(changed) > 0.5 and sum(others) / len(others) < 0.05
