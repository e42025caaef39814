"""op2, op3, op4, op7, op10 and the pipeline."""

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leadlake.llm import exact_dedup, hilbert, line_dedup, mixing, pii, resemblance, simhash, subword, weak_rules

WORD = r"[^\x20\x09-\x0D]+"


def slow_base(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_op2_base_equals_the_patterns():
    rng, rx = random.Random(3), pii._rx()
    bits = ["a", "1", "23", "@", ".", "+", "-", " ", "(", ")", "b.c", "%", "_", "4111111111111111", "255", "256", "@x.y", "\n", "é", "0", "12.3.4.5"]
    for _ in range(5000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert [(pii.KINDS[k], a, z) for k, a, z in pii.base_spans(t, rx)] == slow_base(t), t
    assert pii.base_spans("@" * 50_000 + "1" * 50_000 + "a." * 50_000 + "x" * 200_000, rx) == []


def test_op2_rows(odd, odd_rows, none):
    got = pii.op2(odd).collect()
    assert len(got) == len(odd_rows)
    want = Counter(hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in slow_base(r[1] or "")).encode()).hexdigest() for r in odd_rows)
    assert Counter(r.base_sha256 for r in got) == want
    assert pii.op2(none).collect() == []


def test_op2_learns_contexts(spark):
    """Seeds after fixed words teach those words; a spelt-out address there is found, the same shape elsewhere and numbers beside rivals aren't."""
    rows = [(i, f"filler text please write to user{i}@mail{i}.example.com today or phone +1 (70{i}) 555-00{i}1 soon") for i in range(9)]
    rows += [(100, "filler text please write to jane (at) site dot org today thanks"), (101, "we met jane (at) site dot net once"), (102, "invoice number 555 123 4567 paid")]
    rows += [(103, "or phone 705 555 0199 soon"), (200, "nothing here"), *[(300 + i, f"invoice number X{i}77 paid") for i in range(9)]]
    got = {r.doc_id: r for r in pii.op2(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    span = lambda i: [text[i][int(s.split(":")[1]) : int(s.split(":")[2])] for s in got[i].spans.split(",") if s]
    assert span(100) == ["jane (at) site dot org"] and got[100].n_email == 0 and got[100].n_found == 1
    assert span(103) == ["705 555 0199"]
    assert not span(101) and not span(102) and not span(200) and not any(span(300 + i) for i in range(9))
    assert all(got[i].n_email == 1 and got[i].n_phone == 1 for i in range(9))


def test_op2_places_overlap_nothing():
    rng, rx = random.Random(8), pii._rx()
    bits = ["a@b.co", "1.1.1.1", "-", " ", "555-555-5555", "@x.com", "4111 1111 1111 1111", "+1 (555) 222 3333", ".", "x dot y", " (at) ", "7055550199", "z"]
    texts = ["1.1.1.1-2.2.2.2-3.3.3.3-4.4.4.4-555-555-5555@x.com", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(3000))]
    for t in texts:
        base = pii.base_spans(t, rx)
        more = [(a, z) for _, a, z, w in pii.places(t, rx, base) if w < 1]
        taken = [(a, z) for _, a, z in base]
        for i, (a, z) in enumerate(more):
            assert all(z <= x or y <= a for x, y in taken + more[:i]), t


def test_op2_contexts_are_whole_words():
    assert pii._context("x" * 500 + " call " + "y" * 300 + " 12 now", 807, 809) == pii._context("x" * 500 + " call " + "y" * 300 + " 34 now", 807, 809)
    assert pii._context("one two 5 three", 8, 9) == ["one two _", "two _", "two _ three"] and pii._context("5", 0, 1) == ["^ ^ _", "^ _", "^ _ $"]
    assert pii._context("a" * 200 + "b 5", 202, 203) != pii._context("a" * 200 + "c 5", 202, 203)


def test_op2_discovered_instances_teach_further_patterns(spark):
    """Seeds teach 'reach us'; candidates there teach 'mailbox'; what stands only there is found in the next round. Rivals keep 'item' out."""
    rows = [(i, f"you can reach us at user{i}@mail{i}.example.com for more") for i in range(8)]
    rows += [(20 + i, f"you can reach us at p{i} (at) site{i} dot org for more") for i in range(6)]
    rows += [(40 + i, f"the old mailbox was p{i} (at) site{i} dot org then") for i in range(6)]
    rows += [(60, "the old mailbox was bob (at) other dot net then"), (61, "an item number 705 555 0199 here"), (62, "phone line 7055550199 is open")]
    rows += [(70 + i, f"phone line +1 (70{i}) 555-00{i}1 is open") for i in range(7)] + [(80 + i, f"an item number A{i}7 here") for i in range(7)]
    text = dict(rows)
    got = {r.doc_id: [text[r.doc_id][int(a) : int(z)] for _, a, z in (s.split(":") for s in r.spans.split(",") if s)] for r in pii.op2(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(6):
        assert got[20 + i] == got[40 + i] == [f"p{i} (at) site{i} dot org"]
    assert got[60] == ["bob (at) other dot net"] and got[61] == [] and got[62] == ["7055550199"]


def test_op3_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = subword.op3(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 60
    assert sum(r.predicted == r.quality for r in got) / len(got) >= 0.95
    assert sum(r.predicted for r in got if r.quality == 1) / sum(r.quality for r in got) >= 0.97


def test_op3_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, int(i % 2), None) for i in range(40, 100)] + [(None, 1, 1), (41, 0, 0), (42, None, 0)], "doc_id long, quality int, toxic int")
    got = subword.op3(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    again = subword.op3(odd, labels).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert {r.score for r in subword.op3(odd, labels.limit(0)).collect()} == {1.0}
    assert subword.op3(none, labels).collect() == []
    left = subword.survivors(odd, labels)
    assert left.columns == odd.columns


def test_op3_folded_scores_equal_the_network():
    import pyarrow as pa

    rng = random.Random(1)
    texts = ["", "a a a a b", *(" ".join(rng.choice("ab cd eé fgh") * 2 for _ in range(30)) for _ in range(20))]
    arr = pa.array(texts, pa.large_string())
    feats = subword.document_features(arr)
    vec, out, bias = subword.train(feats, np.array([i % 2 for i in range(len(texts))]))
    z = np.array([out @ (w @ vec[i]) + bias for i, w in feats])
    want = 1 / (1 + np.exp(z[:, 0] - z[:, 1]))
    model = subword.Model((vec @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0]))
    assert np.allclose(model.score(arr), want, atol=1e-4)


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (3, 4), (4, 2)])
def test_hilbert_curve_steps_to_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    h = hilbert.hilbert_index(cells, bits)
    assert sorted(h) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(h)], axis=0)).sum(axis=1) == 1).all()


def test_op4(odd, odd_rows, none, tmp_path, spark):
    got = hilbert.op4(odd).collect()
    assert len(got) == len(odd_rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert r.law == "rows" and r.grown_shard is None
    assert sorted(by) == list(range(16))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in by.values())
    order = [(max(r._curve for r in by[k]), min(r._curve for r in by[k])) for k in range(16)]
    assert all(a[0] <= b[1] for a, b in zip(order, order[1:], strict=False))
    assert hilbert.op4(none).collect() == []
    hilbert.write_shards(odd, str(tmp_path / "out"), ["source", "lang", "size"], 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(odd_rows) and back.select("shard").distinct().count() == 4


def test_op4_strings_that_begin_alike_prune(spark):
    rows = [(i, "t", f"common-crawl-{i % 16:02d}") for i in range(320)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = hilbert.shards(df, ["source"], 16).collect()
    assert len({r._curve for r in got}) == 16 and all(len({r.dim_source for r in got if r.shard == k}) == 1 for k in range(16))


def test_op4_written_shards_follow_the_law_with_repeated_rows(spark, tmp_path):
    df = spark.createDataFrame([(7, "same", "s")] * 40 + [(i, "t", "u") for i in range(23)], "doc_id long, text string, source string")
    hilbert.write_shards(df, str(tmp_path / "o"), ["source", "size"], 4)
    n = [r["count"] for r in spark.read.parquet(str(tmp_path / "o")).groupBy("shard").count().collect()]
    assert sorted(n) == [15, 16, 16, 16]


def slow_rules(t):
    w = re.findall(WORD, t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c, cov = Counter(wins), set()
    for i, x in enumerate(wins):
        if c[x] > 1:
            cov |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cov)


def test_op7_statistics(odd, odd_rows, none):
    got = weak_rules.op7(odd).collect()
    want = Counter((r[0], *slow_rules(r[1] or "")) for r in odd_rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert weak_rules.op7(none).collect() == []


def test_op7_verdicts(odd, odd_rows):
    """kept and quality from votes counted here and EM in numpy, document by document."""
    got = weak_rules.op7(odd).collect()
    rules = list(weak_rules.votes())
    votes = np.array([[r[v] for v in rules] for r in got])
    rate = {(j, c, v): weak_rules.START[c][v + 1] for j in range(len(rules)) for c in (0, 1) for v in (-1, 0, 1)}
    prior = weak_rules.PRIOR_GOOD
    good = lambda: 1 / (1 + np.array([np.exp(-np.log(prior / (1 - prior)) - sum(np.log(rate[j, 1, v] / rate[j, 0, v]) for j, v in enumerate(row))) for row in votes]))
    for _ in range(weak_rules.ROUNDS):
        g = good()
        prior = min(max(g.mean(), weak_rules.FLOOR), 1 - weak_rules.FLOOR)
        for j in range(len(rules)):
            for v in (-1, 0, 1):
                on = votes[:, j] == v
                rate[j, 1, v] = max(weak_rules.FLOOR, (g[on].sum() + 1) / (g.sum() + 3))
                rate[j, 0, v] = max(weak_rules.FLOOR, ((1 - g[on]).sum() + 1) / ((1 - g).sum() + 3))
    for r, q in zip(got, good(), strict=True):
        assert abs(r.quality - q) < 1e-5 and r.kept == (not r.base_failed and r.quality >= weak_rules.KEEP)
    text = {r[0]: r[1] or "" for r in odd_rows}
    for r in got:
        t = text[r.doc_id]
        if r.n_words:
            letters = sum(c.isalpha() for c in t) / r.word_chars
            assert r.v_letters == (1 if letters > 0.9 else -1 if letters < 0.8 else 0)
            assert r.v_upper == (-1 if sum("A" <= c <= "Z" for c in t) / r.word_chars > 0.4 else 0)
            assert r.v_shouts == (-1 if sum(c in "!?" for c in t) / r.n_words > 0.3 else 0)
            assert r.v_digits == (-1 if sum(c in "0123456789" for c in t) / r.word_chars > 0.2 else 0)
            assert r.v_types == (-1 if len(set(re.findall(WORD, t))) / r.n_words < 0.2 else 0)
            stops = t.count(".") / r.n_words
            assert r.v_stops == (-1 if stops > 0.6 or stops < 0.004 else 1 if 0.01 <= stops <= 0.3 else 0)


def test_op7_expectation_maximisation(spark):
    """Against the same rounds in numpy, on made votes."""
    rng = np.random.default_rng(0)
    rules = ["a", "b", "c", "d"]
    good = rng.random(4000) < 0.8
    votes = np.array([[rng.choice([-1, 0, 1], p=[0.03, 0.5, 0.47] if g else [0.5, 0.4, 0.1]) for _ in rules] for g in good])
    pats = Counter(map(tuple, votes.tolist()))
    df = spark.createDataFrame([(*map(int, k), n) for k, n in pats.items()], "a int, b int, c int, d int, n long")
    prior, rate = weak_rules.em(df, rules, 8)
    keys, ns = np.array(list(pats)), np.array(list(pats.values()))
    p0, r0 = weak_rules.PRIOR_GOOD, {(j, c, v): weak_rules.START[c][v + 1] for j in range(4) for c in (0, 1) for v in (-1, 0, 1)}
    for _ in range(8):
        like = [np.array([np.prod([r0[j, c, v] for j, v in enumerate(k)]) for k in keys]) for c in (0, 1)]
        post = p0 * like[1] / (p0 * like[1] + (1 - p0) * like[0])
        g = (ns * post).sum()
        p0 = g / ns.sum()
        for j in range(4):
            for v in (-1, 0, 1):
                a, b = (ns * post * (keys[:, j] == v)).sum(), (ns * (1 - post) * (keys[:, j] == v)).sum()
                r0[j, 1, v], r0[j, 0, v] = max(weak_rules.FLOOR, (a + 1) / (g + 3)), max(weak_rules.FLOOR, (b + 1) / (ns.sum() - g + 3))
    assert abs(prior - p0) < 1e-9 and all(abs(rate[rules[j], c, v] - x) < 1e-9 for (j, c, v), x in r0.items())
    assert abs(prior - good.mean()) < 0.1


def slow_mix(rows):
    size = lambda t: len(re.findall(WORD, t or ""))
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append((hashlib.md5(str(r[0]).encode() if r[0] is not None else b"").hexdigest(), size(r[1])))
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + ([None] if None in by else [])
    total = sum(n for v in by.values() for _, n in v)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    cap = {s: 3 * sum(n for _, n in by[s]) for s in names}
    goal, left = {}, dict(weight)
    while left:
        share = (total - sum(goal.values())) / sum(left.values())
        over = [s for s in left if share * left[s] > cap[s]]
        for s in over or list(left):
            goal[s] = float(cap[s]) if over else share * left[s]
            del left[s]
    return goal


def test_op10(odd, odd_rows, none):
    got = mixing.op10(odd).collect()
    goal = slow_mix(odd_rows)
    assert len(got) == len(odd_rows)
    taken, sizes = Counter(), Counter()
    for r in got:
        assert abs(r.target - goal[r.source]) < 1e-6
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
        sizes[r.source] += r.size
    for s, t in goal.items():
        assert taken[s] == int(t) and all(r.source_size == sizes[s] for r in got if r.source == s)
    assert sorted(map(str, got)) == sorted(map(str, mixing.op10(odd.repartition(7)).collect()))
    assert mixing.op10(none).collect() == []


def _source_words(df):
    return {r.s: r.n for r in df.groupBy(F.col("source").alias("s")).agg(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))).alias("n")).collect() if r.n}


def test_op10_materialised_words(spark, odd):
    """Exactly the budget of each source, whatever rows repeat, and whichever names the columns have."""
    out = mixing.materialise(odd)
    assert out.columns == odd.columns
    goal = {r.source: int(r.target) for r in mixing.op10(odd).collect() if int(r.target)}
    assert _source_words(out) == goal
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (1, "a b c d", "x"), (1, "a b c d", "y"), (2, "e f", "x"), (None, "g h i", "z"), (None, "g h i", "z"), (3, "", "z")]
    again = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {}
    for r in mixing.op10(again).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert _source_words(mixing.materialise(again)) == {s: n for s, n in taken.items() if n}


def test_columns_with_clashing_names(spark, tmp_path):
    """No operator that returns documents stumbles over, or changes, columns that are called as its own working columns."""
    names = "_size _taken _left _mix_id _mix_x _id _crc _spans _score score _drop_id _stay_id _own_digest _gone_id row id own x key words left slot _slot no text_hash fp n digest stays shard_ crc spans lo hi".split()
    rows = [(i, f"text number {i % 12} with some more words of it", "s", *[f"{n}-{i}" for n in names]) for i in range(30)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, source string, {', '.join(f'`{n}` string' for n in names)}")
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    own = lambda df: sorted((r.doc_id, *[r[n] for n in names]) for r in df.collect())
    want = {(r[0], *r[3:]) for r in rows}
    for out in (mixing.materialise(docs), line_dedup.clean(docs), subword.survivors(docs, labels), exact_dedup.survivors(docs), simhash.survivors(docs), resemblance.survivors(docs)):
        assert out.columns == docs.columns and set(own(out)) <= want and out.count() > 0
    hilbert.write_shards(docs, str(tmp_path / "o"), ["source", "_size"], 3)
    assert own(spark.read.parquet(str(tmp_path / "o"))) == sorted(want)


def slow_mixed(rows):
    """(doc_id, text) of the mixed corpus of rows (doc_id, text, lang, source, n_chars), each as often as it comes."""
    goal, out, by = slow_mix(rows), Counter(), defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    for s, own in by.items():
        own.sort(key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0]))
        budget = int(goal[s])
        while budget > 0 and any(re.findall(WORD, r[1] or "") for r in own):
            for r in own:
                w = list(re.finditer(WORD, r[1] or ""))
                if w and budget > 0:
                    out[r[0], r[1] if len(w) <= budget else r[1][: w[budget - 1].end()]] += 1
                    budget -= min(budget, len(w))
    return out


def test_pipeline_against_brute_force(spark):
    """Every stage on its own input, and run() as a whole; the classifier's verdict is op3's, held against the network and labels above."""
    from test_resemblance import slow_components
    from tokenizers import Tokenizer

    from leadlake.llm.tokens import default_path

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    good = {r.doc_id for r in subword.op3(docs, labels).collect() if r.predicted == 1}
    at, rows, names = docs, [tuple(r) for r in docs.collect()], [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "mix", "pack"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "quality":
            want = Counter((r[0], r[1]) for r in rows if r[0] in good)
        elif name == "exact_dedup":
            best = {}
            for r in rows:
                best[r[1]] = max(best.get(r[1], -1), r[0])
            want = Counter((i, t) for t, i in best.items())
        elif name == "near_dedup":
            comp = slow_components([(r[0], r[1]) for r in rows])
            want = Counter((r[0], r[1]) for r, c in zip(rows, comp, strict=True) if r[0] == c)
        else:
            want = slow_mixed(rows)
        at = corpus_pipeline.cut(stage(spark, at, d), f"test-{name}")
        assert at.columns == docs.columns, name
        rows = [tuple(r) for r in at.collect()]
        assert Counter((r[0], r[1]) for r in rows) == want and want, name
    tok = Tokenizer.from_file(default_path())
    ids = Counter((r[0], tuple([*tok.encode(r[1], add_special_tokens=False).ids, 2])) for r in rows)
    pieces = corpus_pipeline.run(spark, d).collect()
    assert sum(p.length for p in pieces) == sum(len(t) * n for (_, t), n in ids.items())
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    starts = Counter((p.doc_id, p.start, p.length, p.ids_crc32) for p in pieces)
    for (i, t), n in ids.items():
        mine = [k for k in starts if k[0] == i and crc(t[k[1] : k[1] + k[2]]) == k[3] and len(t[k[1] : k[1] + k[2]]) == k[2]]
        covered = np.zeros(len(t), int)
        for k in mine:
            covered[k[1] : k[1] + k[2]] += 1
        assert (covered >= 1).all()
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    for v in by.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:], strict=False)) and sum(v[-1]) <= 4096
    known = {r.doc_id: r.quality for r in labels.collect()}
    fine = [i for i, q in known.items() if q == 1]
    assert sum(i in good for i in fine) >= 0.95 * len(fine)


def test_scratch_tables_go_but_for_those_that_the_result_reads(spark, odd):
    from leadlake.llm._common import shared_dir, tidy

    at = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(at))
    out = tidy(exact_dedup.op5)(odd)
    left = {n.split("-")[2] for n in set(os.listdir(at)) - before if n.startswith("leadlake-")}
    assert left == {"log", "level"} and out.count() == odd.count()


def test_pipeline_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60, 100)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd), ("none", none)):
        at = str(tmp_path / name)
        docs.write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        n = corpus_pipeline.run(spark, at).count()
        assert n == 0 if name == "none" else n >= 0
