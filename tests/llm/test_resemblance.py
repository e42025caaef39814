"""The pipeline's near-dedup against brute force over sets of 5-word shingles."""

import random
import re
from itertools import combinations

import pytest

import corpus_pipeline
from leadlake.llm import cells, resemblance, simhash


def slow_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def slow_components(rows):
    sets = [slow_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            up[find(j)] = find(i)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(rows))]


@pytest.fixture(scope="module")
def near_rows(odd_rows):
    """Copies with 0 to 12 changed words around the bound, chains, a passage that many unlike texts share, short texts."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    out = [(r[0], r[1]) for r in odd_rows]
    for g in range(12):
        base = [word() for _ in range(rng.choice([12, 40, 150, 300]))]
        for c in range(9):
            w = list(base)
            for at in rng.sample(range(len(w)), min(len(w), rng.randint(0, 12))):
                w[at] = word()
            out.append((1000 + 10 * g + c, " ".join(w)))
    chain = [word() for _ in range(200)]
    for c in range(15):
        chain[13 * c % 200] = word()
        chain[(13 * c + 90) % 200] = word()
        out.append((2000 + c, " ".join(chain)))
    passage = " ".join(word() for _ in range(30))
    out += [(3000 + c, f"{' '.join(word() for _ in range(20))} {passage} {word()}") for c in range(30)]
    out += [(3100, "A b C"), (3101, "a B\nc"), (3102, "a b d")]
    return out


@pytest.mark.parametrize("side", [8192, 3])
def test_components_are_those_of_brute_force(spark, near_rows, monkeypatch, side):
    monkeypatch.setattr(cells, "SIDE", side)
    monkeypatch.setattr(resemblance, "FEW", 2 if side > 3 else 1e9)  # all components are compared after the first turn
    docs = spark.createDataFrame(near_rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), str(r.component_id)) for r in resemblance.near_duplicates(docs).collect())
    want = slow_components(near_rows)
    assert got == sorted(zip([str(i) for i, _ in near_rows], map(str, want), strict=True))


def test_the_pipelines_stage_goes_through_simhash(spark, near_rows, monkeypatch):
    """Fingerprints of the same shingles are linked by simhash.links, and links of similar sets join before any bucket is compared."""
    seen, plain, checked, check = [], simhash.links, {}, resemblance._Checker.links
    monkeypatch.setattr(simhash, "links", lambda fps: seen.append((fps.collect(), plain(fps))) or seen[-1][1])

    def links(self, pairs, name, files):
        out = check(self, pairs, name, files)
        checked[name] = (pairs.count(), out.count())
        return out

    monkeypatch.setattr(resemblance._Checker, "links", links)
    corpus_pipeline.near(spark, spark.createDataFrame(near_rows, "doc_id long, text string"), "").count()
    [(fps, _)] = seen
    texts = [(t or "").encode() for _, t in near_rows]
    want = {simhash.fingerprint_of(simhash.shingle_hashes(t, 5)) for t in texts}
    assert {r.fp % (1 << 64) for r in fps} <= want and len(fps) > 0.9 * len(want)
    assert next(iter(checked)) == "near-simhash" and checked["near-simhash"][0] >= checked["near-simhash"][1] > 10


def test_the_pipelines_stage_leaves_one_of_each_near_copy(spark, odd, near_rows, none):
    docs = spark.createDataFrame(near_rows, "doc_id long, text string")
    want = {i for (i, _), c in zip(near_rows, slow_components(near_rows), strict=True) if i is None or i == c}
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, "").select("doc_id").collect()} == want
    assert corpus_pipeline.near(spark, odd, "").columns == odd.columns and corpus_pipeline.near(spark, none, "").collect() == []
