"""Joins, merges, windows and states against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from leadlake.functions import facts as E
from leadlake.operators import merge as M
from leadlake.operators import relational as J
from leadlake.operators import scores as S
from leadlake.operators import states
from leadlake.operators import windows as O
from leadlake.sources import readers, writers

T0 = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_latest_and_first(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 3, "w"), ("b", 2, None)], "k string, t int, v string")
    assert rows(J.latest_by(df, ["k"], ["t", "v"])) == [("a", 3, "y"), ("b", 2, None)]
    assert rows(J.latest(df, ["k"], [F.col("t").desc(), F.col("v").desc()])) == [("a", 3, "y"), ("b", 2, None)]
    assert rows(J.keep_first(df.where("t < 3"), ["k"], "t")) == [("a", 1, "x"), ("b", 2, None)]


def test_candidates_merge_by_root(spark):
    df = spark.createDataFrame([("q", "stripe.com", "searxng", 1, "S"), ("q", "www.stripe.com", "searxng", 2, "T"), ("q", "stripe.com", "postgres", 3, "P"), ("q", "", "searxng", 4, "N")], "q string, domain string, source string, pos int, name string")
    got = J.merge_candidates(df, ["q"], "domain", "source", "pos").collect()
    assert [(r.source, r.name, r.pos) for r in got] == [("postgres", "P", 1)]


def test_either_key_and_cascade(spark):
    left = spark.createDataFrame([(1, "s1"), (2, "s2"), (3, "s9")], "company int, session string")
    right = spark.createDataFrame([(10, 1, None), (11, None, "s2"), (12, 1, "s1")], "id int, c int, s string")
    assert [(r.company, r.id) for r in J.either_key(left, right, [("company", "c"), ("session", "s")], "id").orderBy("id").collect()] == [(1, 10), (2, 11), (1, 12)]
    a = spark.createDataFrame([("d1", "A")], "k string, v string")
    b = spark.createDataFrame([("d1", "B"), ("d2", "B2")], "k string, v string")
    base = spark.createDataFrame([(1, "d1", "d1"), (2, "zz", "d2"), (3, None, "zz")], "id int, x string, y string")
    got = J.first_match(base, [(a, "x", "k"), (b, "y", "k")], "id").orderBy("id").collect()
    assert [(r.hit_v, r.matched_by) for r in got] == [("A", 0), ("B2", 1), (None, None)]


def test_either_key_tells_each_pair_once_without_keeping_pairs(spark):
    """Rows of one name with several keys, null keys and repeated rows, against brute force; nothing is aggregated after the joins."""
    import random

    rng = random.Random(3)
    pick = lambda n: rng.choice([None, *range(n)])
    left = [(rng.randrange(40), pick(6), pick(6)) for _ in range(60)] * 2
    right = [(rng.randrange(9), pick(4), pick(6), pick(6)) for _ in range(60)] * 2
    l, r = spark.createDataFrame(left, "id int, a int, b int"), spark.createDataFrame(right, "x int, y int, c int, d int")
    out = J.either_key(l, r, [("a", "c"), ("b", "d")], ["x", "y"])
    want = {(i, x, y) for i, a, b in left for x, y, c, d in right if (a is not None and a == c) or (b is not None and b == d)}
    got = [(q.id, q.x, q.y) for q in out.collect()]
    assert len(got) == len(want) and set(got) == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


def test_lines_of_null_keys_are_not_one(spark, tmp_path):
    """A line is named by its two columns: of (null, 5) and (5, null) none stands for the other. Repeated rows count once."""
    from leadlake.plans import catalogue

    spark.createDataFrame([(1, 7), (1, 7), (5, 8), (6, None)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    lines = [(None, 5, 7, 50.0), (5, None, 7, 50.0), (5, None, 7, 50.0), (1, 1, 7, 50.0), (6, 1, None, 50.0), (6, 2, 8, 10.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sorted(map(str, (tuple(r) for r in catalogue.queries()["evidence_by_either_key"](spark, str(tmp_path)).collect())))
    assert got == sorted(map(str, [(1, None, 5), (1, 5, None), (1, 1, 1), (5, 5, None), (6, 6, 1)]))


def test_people_and_names(spark):
    c = spark.createDataFrame([("Acme Inc.", "acme.io"), ("Zed", "globex.com")], "name string, domain string")
    p = spark.createDataFrame([("Jane", "acme"), ("Joe", "Globex Holdings"), ("Jim", "other")], "person string, company string")
    got = {r.name: [x.person for x in r.people or []] for r in J.people_of_companies(c, p, "name", "domain", "company").collect()}
    assert got == {"Acme Inc.": ["Jane"], "Zed": ["Joe"]}
    old = spark.createDataFrame([(1, "Jane Doe")], "c int, n string")
    new = spark.createDataFrame([(1, "jane doe"), (1, "Joe"), (1, "JOE"), (2, "Jane Doe")], "c int, n string")
    assert J.new_names(old, new, ["c"], "n").count() == 3


def test_resolve_and_investigate(spark):
    companies = spark.createDataFrame([(1, "Acme Inc.", None, "acme.io"), (2, "Acme Tools", "Acme Tools Ltd", "tools.io"), (3, "Globex", None, "globex.com"), (4, "Globex", None, "globex.de")], "id int, canonical_name string, legal_name string, primary_domain string")
    req = spark.createDataFrame([(1, "ACME", None), (2, "x", "www.globex.com"), (3, "Globex", None), (4, "Tools", None), (5, "Nobody", None)], "request_id int, company_name string, domain string")
    got = {r.request_id: (r.status, [c.id for c in r.candidates or []]) for r in J.resolve(req, companies).collect()}
    assert got == {1: ("AMBIGUOUS", [1, 2]), 2: ("EXISTING", [3]), 3: ("AMBIGUOUS", [3, 4]), 4: ("EXISTING", [2]), 5: ("NOT_FOUND", [])}
    # inside a word, two letters, by legal name or domain alone, without legal form; web hits for what the store does not know
    more = spark.createDataFrame([(1, "Microsoft", None, "microsoft.com"), (2, "HP", "Hewlett Packard", "hp.com"), (3, "Zed", "Orion Labs GmbH", "zed.io"), (4, "Q", None, "quux-tools.io")], "id int, canonical_name string, legal_name string, primary_domain string")
    ask = spark.createDataFrame([(i, n, None) for i, n in enumerate(["soft", "HP", "orion labs", "quux", "50%", "Nova", "Lumo", "Vex", "Kuma", "quux-tools.io"])], "request_id int, company_name string, domain string")
    web = spark.createDataFrame([(5, 1, "https://www.nova.io/a", "Nova"), (5, 2, "https://nova.io/b", "Nova b"), (6, 1, "https://lumo.io", ""), (6, 2, "https://lumo.de", "Lumo DE"), (7, 1, "http://10.0.0.1/", "x"), (8, 1, "https://kuma.io", "K")], "request_id int, rank int, url string, title string")
    out = {r.request_id: r for r in J.resolve(ask, more, web, spark.createDataFrame([(7,), (5,)], "request_id int"), spark.createDataFrame([("KUMA.io",)], "domain string")).collect()}
    assert [out[i].status for i in range(10)] == ["EXISTING"] * 4 + ["NOT_FOUND", "UNIQUE", "AMBIGUOUS", "RESOLUTION_RETRY_PENDING", "NOT_FOUND", "EXISTING"]
    assert [out[i].candidates[0].id for i in (0, 1, 2, 3, 9)] == [1, 2, 3, 4, 4]
    assert out[5].web_candidates[0].domain == "nova.io" and out[6].web_candidates[0].canonical_name == "Lumo"
    day = dt.timedelta(days=1)
    sess = spark.createDataFrame([("a.io", "VERIFIED", T0 - 2 * day, None, 1), ("b.io", "VERIFIED", T0 - 10 * day, None, 2), ("c.io", "PHASE1_VERIFYING", T0, None, 3)], "domain string, status string, updated_at timestamp_ntz, verified_at timestamp_ntz, id int")
    r = spark.createDataFrame([(1, "a.io", False), (2, "b.io", False), (3, "c.io", False), (4, "10.0.0.1", False), (5, "d.io", True), (6, "e.io", False)], "request_id int, domain string, blocked boolean")
    got = {x.request_id: (x.decision, x.priority) for x in J.investigate(r, sess, "2024-01-01 00:00:00", ["PHASE1_VERIFYING"]).collect()}
    assert got == {1: ("CACHE_HIT", None), 2: ("AGENT1_QUEUED", 9), 3: ("ALREADY_RUNNING", None), 4: ("REJECTED_PRIVATE", None), 5: ("REJECTED_BLOCKED", None), 6: ("AGENT1_QUEUED", 9)}


def test_frontier(spark):
    u = lambda x: f"https://a.com/{x}"
    links = [(u("0"), u("1"), 0), (u("0"), u("2"), 1), (u("1"), u("0"), 1), (u("2"), u("3"), 1), (u("2"), "https://b.com/", 0), *[(u("1"), u(f"n{i}"), 2) for i in range(9)]]
    spark.sparkContext.setCheckpointDir("/tmp/leadlake-test-checkpoints")
    got = J.crawl_frontier(spark.createDataFrame([(u("0"),)], "url string"), spark.createDataFrame(links, "src string, dst string, score int"), 3).collect()
    assert {r.url: r.depth for r in got if "n" not in r.url.rpartition("/")[2]} == {u("0"): 0, u("1"): 1, u("2"): 1, u("3"): 2}
    assert sum("n" in r.url.rpartition("/")[2] for r in got) == 5


def test_merge_rules(spark):
    old = spark.createDataFrame([("k1", "o", "o", "o", None, {"a": "1"}), ("k2", "o", "o", "o", "o", None)], "k string, a string, b string, c string, d string, m map<string,string>")
    new = spark.createDataFrame([("k1", None, "", None, "n", {"a": "2", "b": "3"}), ("k3", "n", "n", "n", None, None)], "k string, a string, b string, c string, d string, m map<string,string>")
    got = M.merge(old, new, ["k"], {"a": "overwrite", "b": "truthy_wins", "c": "keep_if_null", "d": "fill", "m": "map_merge"}, {"d": F.lit("def")})
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == [("k1", None, "o", "o", "n", {"a": "2", "b": "3"}), ("k2", "o", "o", "o", "o", None), ("k3", "n", "n", "n", "def", None)]


def test_outbox(spark):
    box = spark.createDataFrame([(1, "PENDING", 0, 1), (2, "RETRY", 4, 2), (3, "RETRY", 5, 3), (4, "COMPLETED", 0, 4), (5, "PENDING", 0, 5)], "id int, status string, retry_count int, created_at int")
    res = spark.createDataFrame([(1, True), (2, False), (3, True), (5, False)], "id int, ok boolean")
    assert rows(M.outbox_step(box, res)) == [(1, "COMPLETED", 0, 1), (2, "FAILED", 5, 2), (3, "RETRY", 5, 3), (4, "COMPLETED", 0, 4), (5, "RETRY", 1, 5)]


def test_blocklist_changes(spark):
    b = spark.createDataFrame([("bad.com", "x", "y")], "domain string, reason_category string, source string")
    h = spark.createDataFrame([("https://www.bad.com/a", "r", "s"), ("sub.bad.com", "r", "s"), ("new.io", "r", "s"), ("new.io", "r", "s")], "url string, reason_category string, source string")
    assert [r.domain for r in M.block(b, h).orderBy("domain").collect()] == ["bad.com", "new.io"]
    assert M.unblock(b, h).count() == 0
    q = spark.createDataFrame([(1, "p.io", "PENDING"), (2, "q.io", "PENDING"), (3, "r.io", "PENDING")], "id int, domain string, status string")
    done, blocked = M.review(q, spark.createDataFrame([(1, True), (2, False)], "id int, approve boolean"), b)
    assert [r.status for r in done.orderBy("id").collect()] == ["APPROVED", "REJECTED", "PENDING"] and rows(blocked.select("domain")) == [("bad.com",), ("q.io",)]


def test_sessions_and_people_merges(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "session_id int, v string")
    assert rows(M.replace_session(old, spark.createDataFrame([(1, "z")], "session_id int, v string"))) == [(1, "z"), (2, "c")]
    kind = "company_id int, full_name string, source_url string, verification_status string"
    got = M.rediscover_people(spark.createDataFrame([(1, "Jane Doe", None, "DISCOVERED"), (1, "Joe X", "u0", "DISCOVERED")], kind), spark.createDataFrame([(1, "jane doe", "u1", "N"), (1, "Joe X", "u2", "N"), (1, "New One", "u3", "N")], kind))
    assert rows(got) == [(1, "Jane Doe", "u1", "HIGH_CONFIDENCE"), (1, "Joe X", "u0", "DISCOVERED"), (1, "New One", "u3", "N")]
    c = spark.createDataFrame([(1, "VERIFIED", 0.5), (2, "DISCOVERED", 0.5), (3, "X", 0.1)], "id int, status string, confidence double")
    v = spark.createDataFrame([(1, "NEEDS_REVIEW", 0.2), (2, "VERIFIED", 0.9)], "company_id int, state string, confidence double")
    assert rows(M.promote(c, v)) == [(1, "NEEDS_REVIEW", 0.2), (2, "VERIFIED", 0.9), (3, "X", 0.1)]


def test_windows(spark):
    rng = random.Random(1)
    data = [(k, T0 + dt.timedelta(seconds=i), rng.choice([70.0, 82.0, 96.0]), rng.choice([50.0, 86.0, 91.0, 96.0]), rng.choice([1, 5]), rng.randint(40, 120)) for k in "ab" for i in range(60)]
    df = spark.createDataFrame(data, "k string, ts timestamp_ntz, mem double, cpu double, browsers int, queue_depth int")
    got = {(r.k, r.ts): r.level for r in O.circuit_breaker(df, "k", "ts").collect()}
    for k in "ab":
        full, past = False, []
        for _, ts, mem, cpu, br, q in (d for d in data if d[0] == k):
            past.append(cpu)
            full = True if q >= 100 else False if q <= 60 else full
            last = lambda n, x: len(past) >= n and min(past[-n:]) >= x  # noqa: B023, E731
            want = "EMERGENCY" if mem >= 95 or last(2, 95) else "PAUSED" if mem >= 85 or last(3, 90) or br > 4 or full else "PRESSURE" if mem >= 80 or last(2, 85) else "NORMAL"
            assert got[k, ts] == want


def test_ttl_locks(spark):
    rng = random.Random(4)
    data = sorted((rng.choice("ab"), T0 + dt.timedelta(seconds=rng.randint(0, 3000))) for _ in range(80))
    want, last = [], {}
    for k, ts in sorted(data, key=lambda d: d[1]):
        if k not in last or (ts - last[k]).total_seconds() >= 300:
            last[k] = ts
            want.append((k, ts))
    assert rows(O.ttl_locks(spark.createDataFrame(data, "k string, ts timestamp_ntz"), "k", "ts", 300)) == sorted(want)


def test_keyword_performance(spark):
    data = [("k", i, s, q, p) for i, (s, q, p) in enumerate([(15, "GOOD", 1), (0, "ACCEPTABLE", 0), (5, "GOOD", 0)])] + [("z", i, 0, "ACCEPTABLE", 0) for i in range(3)] + [("p", i, 9, "POOR", 0) for i in range(2)]
    got = {r.keyword: r for r in S.keyword_performance(spark.createDataFrame(data, "keyword string, executed_at int, sources_found int, quality string, people int")).collect()}
    rate = 0.5
    for g in (1.0, 0.0, 5 / 15 * 0.8):
        rate = round(rate * 0.7 + g * 0.3, 4)
    assert got["k"].success_rate == rate and not got["k"].is_deprecated and got["z"].is_deprecated and got["p"].is_deprecated


def test_states(spark):
    df = spark.createDataFrame([(1, "AGENT2_QUEUED", False, "VERIFIED"), (2, "AGENT2_QUEUED", True, "VERIFIED"), (3, "PHASE1_VERIFIED", False, "NEEDS_REVIEW"), (4, "FINAL_VERIFICATION", False, None)], "id int, status string, blocked boolean, verdict string")
    assert [r.final_status for r in states.run(df).orderBy("id").collect()] == ["POSTGRES_VERIFIED", "PHASE1_BLOCKED", "NEEDS_REVIEW", "NEEDS_REVIEW"]


def test_sources(spark, tmp_path):
    q = spark.createDataFrame([('find "Acme Tools" acme.io',), ("crm software",)], "query string")
    assert [(r.title, r.url) for r in readers.direct_entities(q).collect()] == [("Acme", "https://acme.io")]
    assert sorted(r.url for r in readers.profile_hits(q).collect()) == ["https://www.linkedin.com/company/acme-tools", "https://www.linkedin.com/company/crm"]
    assert [r.engine for r in readers.first_tier(readers.direct_entities(q), readers.profile_hits(q)).orderBy("query").collect()] == ["profile", "direct"]
    raw = spark.createDataFrame([("q", 1, None, "u1", "s", "e", None), ("q", 2, "t", "", "s", "e", 1.0), ("q", 3, "t", "u3", "s", "e", 2.0)], "query string, rank int, title string, url string, snippet string, engine string, score double")
    assert [(r.title, r.url, r.score) for r in readers.search_results(raw).orderBy("rank").collect()] == [("B2B Organization", "u1", 1.0), ("t", "u3", 2.0)]
    people = readers.people_queries(spark.createDataFrame([("Acme", "acme.io"), ("Home", None)], "name string, domain string"), [("{domain} ceo", "exec", 1), ("{brand} founder", "exec", 2)])
    assert sorted(r.query for r in people.collect()) == ["Acme founder", "acme.io ceo"]
    (tmp_path / "d.csv").write_text("a,b\n1,2\n3,4\n")
    (tmp_path / "d.txt").write_text("x\ny")
    assert readers.probe_document(spark, str(tmp_path / "d.csv"), "csv")["row_count"] == 2 and readers.probe_document(spark, str(tmp_path / "d.txt"), "text")["line_count"] == 2
    (tmp_path / "s.json").write_text('{"domain": "Tech", "properties": {"name": {"type": ["string", "null"]}, "tags": {"type": "array", "items": {"type": "string"}}, "n": {"type": "integer"}}}')
    reg = readers.SchemaRegistry().load(spark, str(tmp_path))
    assert reg.names() == ["tech"] and reg.register("Food", {})["version"] == "1.0.0"
    js = spark.createDataFrame([('{"name":"x","tags":"one","zz":1}',), ('{"tags":["a","b"],"n":3}',)], "j string")
    got = [tuple(r.v) for r in js.select(readers.enforce(F.col("j"), reg.get("TECH")).alias("v")).collect()]
    assert got == [("x", ["one"], None), (None, ["a", "b"], 3)]
    assert spark.range(1).select(readers.reply(F.lit('```json\n{"a":"1","b":"","c":null}\n```')).alias("m")).first().m == {"a": "1"}


def test_sinks(spark, tmp_path):
    import hashlib

    df = spark.createDataFrame([("a",), ("a",), ("b",)], "c string")
    assert rows(writers.store(df, "c", "text", str(tmp_path / "o"))) == sorted((f"processed/text/{hashlib.sha256(x.encode()).hexdigest()}.txt", x) for x in "ab")
    lead = spark.createDataFrame([(1, "Acme", "https://www.a.io/x", None, "", "I", "T", ["m", "n"], [("J", "CEO"), ("K", None)], ["x", "y"], None, None, T0), (2, "null", "https://b.io", "C", "H", "I", "T", [], [], [], 0.9, "d", T0)], "id int, canonical_name string, url string, country string, headquarters string, industry string, company_tier string, verified_emails array<string>, people array<struct<name:string,title:string>>, technology_stack array<string>, confidence double, description string, created_at timestamp_ntz")
    out = writers.export(lead).collect()
    assert list(out[0].asDict()) == writers.EXPORT and len(out) == 1
    r = out[0]
    assert (r.id, r.domain, r.country, r.headquarters, r.technology_stack, r.verified_emails, r.decision_makers, r.confidence_score, r.summary) == ("1", "a.io", "Global", "Not Specified", "x, y", "m, n", "J (CEO); K (None)", 0.85, "")


def test_existing_files_by_path(spark, tmp_path):
    for name, size in (("acme", 3), ("globex", 5)):
        (tmp_path / "companies" / name).mkdir(parents=True)
        (tmp_path / "companies" / name / "homepage.html").write_bytes(b"x" * size)
    want = spark.createDataFrame([(f"companies/{n}/homepage.html",) for n in ("acme", "globex", "initech")], "p string")
    got = {r.p: r for r in writers.existing(want, "p", spark, str(tmp_path)).collect()}
    assert len(got) == 3 and [got[f"companies/{n}/homepage.html"].exists for n in ("acme", "globex", "initech")] == [True, True, False]
    assert got["companies/globex/homepage.html"].size == 5 and got["companies/initech/homepage.html"].error == "NOT_FOUND"
    lost = writers.existing(want, "p", spark, str(tmp_path / "no")).collect()
    assert all(not r.exists and r.is_infra_error and r.error.startswith("STORE_UNAVAILABLE") and r.backend == "local" for r in lost)


def test_top_k(spark):
    rng = random.Random(2)
    v = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(300)]
    df = spark.createDataFrame(v, "vec_id int, embedding array<float>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    want = sorted(((round(cos(v[5][1], e), 4), i) for i, e in v), key=lambda t: (-t[0], t[1]))[:10]
    got = J.top_k(df, spark.createDataFrame([(5, v[5][1])], "query_id int, query array<double>"), 10).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [i for _, i in want] and got[0].score == pytest.approx(1.0)
    many = [tuple(r) for r in J.top_k(df, df.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 10, block=7).select("query_id", "vec_id", "rank").collect()]
    for i in range(0, 300, 20):
        best = sorted(((-round(cos(v[i][1], e), 6), j) for j, e in v))[:10]
        assert [j for q, j, r in sorted(many, key=lambda x: x[2]) if q == i] == [j for _, j in best]


def test_recall_of_the_approximate_search(spark, sf):
    """At the registered parameters, against the exact search."""
    from leadlake.plans import catalogue

    got, want = ({(r.query_id, r.vec_id) for r in catalogue.queries()[n](spark, sf).collect()} for n in ("semantic_topk_approximate", "semantic_topk"))
    assert want and len(got & want) / len(want) >= 0.9


def test_top_k_ties_and_zero_vectors(spark):
    v = [(i, [1.0, 0.0]) for i in range(50)] + [(90, [0.0, 0.0])]
    df = spark.createDataFrame(v, "vec_id int, embedding array<float>")
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0])], "query_id int, query array<double>")
    assert [tuple(r) for r in J.top_k(df, q, 3, block=4).orderBy("rank").collect()] == [(1, 0, 1.0, 1), (1, 1, 1.0, 2), (1, 2, 1.0, 3)]
    assert df.select(E.cosine(F.col("embedding"), F.array(*[F.lit(0.0)] * 2)).alias("c")).first().c is None


def test_resolve_folds_roots_and_bounds_hits(spark):
    """Two records of one root are one company; many records that hold a letter keep the first ten; records without a root count only alone."""
    rows = [(1, "Same", None, "www.same.io"), (2, "Same", None, "shop.same.io"), (3, "Bare", None, None), (4, "Twice", None, None), (5, "Twice", None, "t.io")]
    rows += [(100 + i, f"xq firm {i}", None, f"f{i}.com") for i in range(300)]
    companies = spark.createDataFrame(rows, "id int, canonical_name string, legal_name string, primary_domain string")
    ask = spark.createDataFrame([(1, "SAME Ltd.", None), (2, "bare", None), (3, "Twice", None), (4, "q", None), (5, None, None)], "request_id int, company_name string, domain string")
    got = {r.request_id: (r.status, [c.id for c in r.candidates or []]) for r in J.resolve(ask, companies).collect()}
    assert got == {1: ("EXISTING", [2]), 2: ("EXISTING", [3]), 3: ("EXISTING", [5]), 4: ("AMBIGUOUS", list(range(100, 110))), 5: ("NOT_FOUND", [])}


def test_resolve_looks_up_each_name_once(spark, monkeypatch):
    """Many requests for a name, a part of one or a domain that many records have: no written table has more rows than the bounds allow."""
    rows = [(i, f"maker{i % 3}", "Maker Group" if i % 2 else None, f"m{i}.io" if i % 3 else "www.all.io") for i in range(600)]
    companies = spark.createDataFrame(rows, "id int, canonical_name string, legal_name string, primary_domain string").repartition(3)
    asks = [("Maker1 Ltd.", None), ("maker0", None), ("KER", None), ("group", None), ("x", "all.io"), ("makerz", None)]
    ask = spark.createDataFrame([(i, *asks[i % 6]) for i in range(240)], "request_id int, company_name string, domain string")
    written, plain = {}, J.kept
    monkeypatch.setattr(J, "kept", lambda df, name: written.setdefault(name, plain(df, name)))
    got = {r.request_id: (r.status, [c.id for c in r.candidates or []]) for r in J.resolve(ask, companies).collect()}
    want = [("AMBIGUOUS", [1, 4, 7, 10, 13]), ("EXISTING", [12]), ("AMBIGUOUS", [1, 2, 4, 5, 7, 8, 9]), ("AMBIGUOUS", [1, 5, 7, 11, 13, 15, 17, 19]), ("EXISTING", [597]), ("NOT_FOUND", [])]
    assert got == {i: want[i % 6] for i in range(240)}
    assert written["resolve-exact"].count() == 40 * (5 + 5 + 1) and written["resolve-hits"].count() == 40 * (5 + 5 + 1 + 10 + 10)


def test_top_k_passes_over_broken_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, []), (5, [1.0, 0.0, 0.0]), (6, [1.0, 1.0])], "vec_id long, embedding array<double>")
    q = v.selectExpr("vec_id as query_id", "embedding as query")
    got = sorted((r.query_id, r.vec_id, r.score) for r in J.top_k(v, q, 3).collect())
    assert got == [(1, 1, 1.0), (1, 6, 0.707107), (5, 5, 1.0), (6, 1, 0.707107), (6, 6, 1.0)]


def test_people_do_not_depend_on_the_order_of_firms(spark):
    c = spark.createDataFrame([("Firm %d" % (i % 7), "d%d.io" % i) for i in range(40)], "name string, domain string").repartition(5)
    p = spark.createDataFrame([("p%d" % i, "Firm %d Ltd." % (i % 9)) for i in range(300)], "person string, company string")
    for r in J.people_of_companies(c, p, "name", "domain", "company", 4).collect():
        assert [x.company for x in r.people] == [r.name + " Ltd."] * 4
