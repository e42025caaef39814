"""Phrases against a scan of each text; probes of folders."""

import json
import random

from leadlake.operators import phrases as P
from leadlake.operators import windows as O
from leadlake.sources import folders


def test_phrases_against_a_scan(spark):
    rng = random.Random(3)
    words = ["ai", "deep", "learning", "store", "Café", "x1"]
    texts = [(i, rng.choice([" ", "-", ". "]).join(rng.choice(words) for _ in range(rng.randint(0, 25)))) for i in range(60)] + [(100, None), (101, ""), (None, "deep learning deep learning")]
    table = [("A", "deep learning"), ("A", "AI"), ("B", "learning deep learning"), ("B", "café"), ("C", "deep"), ("C", "deep"), ("C", ""), ("D", "not there"), ("E", "deep  Learning!")]
    got = sorted((r.id, r.sector, r.phrase, r.position) for r in P.phrase_hits(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(table, "sector string, phrase string"), "id", "text", "phrase").collect() if r.id is not None)
    want = []
    split = lambda t: [w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()]
    for i, t in texts:
        w = split(t or "")
        for s, p in set(table):
            q = split(p)
            want += [(i, s, p, k) for k in range(len(w)) if i is not None and q and w[k : k + len(q)] == q]
    assert got == sorted(want) and len(got) > 200


def test_probe_of_a_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,"name"\n' + "".join(f"{i},n{i}\n" for i in range(40)))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.csv").write_text("x\n")
    (tmp_path / "t.txt").write_text("one\ntwo\n")
    (tmp_path / "l.json").write_text(json.dumps([{"b": 1, "a": "x"}, {"c": None}]))
    (tmp_path / "o.json").write_text('{"k": "v"}')
    (tmp_path / "other.bin").write_bytes(b"\x00")
    got = {r.file.rsplit("/", 1)[1]: r for r in folders.probe_folder(spark, str(tmp_path)).collect()}
    assert {n: (r.kind, r.row_count, r.columns) for n, r in got.items()} == {
        "a.csv": ("csv", 40, ["id", "name"]), "b.csv": ("csv", 0, ["x"]), "t.txt": ("text", 2, []), "l.json": ("json", 2, ["a", "b", "c"]), "o.json": ("json", 1, ["k"]),
    }
    assert got["a.csv"].sample == [f"{i},n{i}" for i in range(5)] and got["t.txt"].sample == ["one\ntwo"] and json.loads(got["o.json"].sample[0]) == {"k": "v"}


def test_locks_of_a_busy_key(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(seconds=i)) for i in range(5000)] + [(None, t0), (None, t0), ("b", None)]
    got = O.ttl_locks(spark.createDataFrame(rows, "k string, ts timestamp_ntz").repartition(3), "k", "ts", 300).collect()
    assert sorted((r.ts - t0).total_seconds() for r in got if r.k == "a") == [300.0 * i for i in range(17)] and sum(r.k is None for r in got) == 1
