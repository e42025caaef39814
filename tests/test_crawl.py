"""The bounded crawl against one queue for each site, and the investigation ladder's edges."""

import pytest

from leadlake.operators import crawl as C
from leadlake.operators import investigation as V
from leadlake.plans.catalogue import queries
from leadlake.plans.investigations import site_links
from leadlake.functions import url as U
from pyspark.sql import functions as F


def _queue(seeds, links, scores, same, max_pages, max_depth, noise=5):
    """links: src -> [dst] in place order; scores: (src, dst) -> score."""
    out = []
    for site, home in seeds.items():
        visited, queue, n = [], [(0, 0, 0, 0, home)], 0
        while queue and len(visited) < max_pages:
            queue.sort()
            score, depth, _, _, url = queue.pop(0)
            visited.append(url)
            n += 1
            out.append((site, url, depth, score, n))
            if depth < max_depth and len(visited) + len(queue) < max_pages:
                noisy = 0
                for place, dst in links.get(url, []):
                    if not same(dst, home) or dst in visited or dst in [q[4] for q in queue]:
                        continue
                    s = scores[url, dst]
                    if s == 2:
                        if noisy >= noise:
                            continue
                        noisy += 1
                    queue.append((s, depth + 1, n, place, dst))
    return sorted(out)


@pytest.mark.parametrize("max_pages,max_depth", [(8, 3), (4, 2)])
def test_crawl_of_the_given_pages(spark, sf, max_pages, max_depth):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    seeds = p.select(U.host(F.col("url")).alias("site"), "url")
    edges = site_links(p).where("dst is not null").groupBy("src", "dst").agg(F.min_by("text", "place").alias("text"), F.min("place").alias("place"))
    rows = edges.withColumn("score", U.link_score(F.col("dst"), F.coalesce("text", F.lit("")))).collect()
    links = {}
    for r in sorted(rows, key=lambda r: (r.place, r.dst)):
        links.setdefault(r.src, []).append((r.place, r.dst))
    homes = {r.site: r.url for r in seeds.groupBy("site").agg(F.min("url").alias("url")).collect()}
    bare = lambda u: u.split("//", 1)[1].split("/", 1)[0].removeprefix("www.")
    same = lambda a, b: bare(a) == bare(b) or bare(a).endswith("." + bare(b))
    want = _queue(homes, links, {(r.src, r.dst): r.score for r in rows}, same, max_pages, max_depth)
    got = sorted(tuple(r) for r in C.crawl(seeds, site_links(p), max_pages, max_depth).collect())
    assert got == want
    assert max(r[4] for r in got) == max_pages and max(r[2] for r in got) > (max_pages > 4)
    if (max_pages, max_depth) == (8, 3):
        assert sorted(tuple(r) for r in queries()["priority_crawl"](spark, sf).collect()) == want


def test_crawl_of_odd_links(spark):
    seeds = spark.createDataFrame([("s", "https://s.io/"), ("s", "https://s.io/zz"), (None, "https://n.io/"), ("t", None)], "site string, url string")
    links = [("https://s.io/", f"https://s.io/cart/{i}", i, None) for i in range(9)] + [("https://s.io/", "https://other.io/about", 0, "x"), ("https://s.io/", None, 1, "x"), ("https://s.io/", "https://s.io/", 2, "self")]
    links += [("https://s.io/cart/0", "https://s.io/team", 1, "team"), ("https://s.io/cart/0", "https://s.io/team", 1, "team")]
    got = sorted((r.turn, r.url, r.depth, r.score) for r in C.crawl(seeds, spark.createDataFrame(links, "src string, dst string, place int, text string"), 20, 2).collect())
    assert got[:3] == [(1, "https://s.io/", 0, 0), (2, "https://s.io/cart/0", 1, 2), (3, "https://s.io/team", 2, 0)]
    assert [g[1] for g in got[3:]] == [f"https://s.io/cart/{i}" for i in range(1, 5)]  # five of noise
    assert C.crawl(seeds.limit(0), spark.createDataFrame(links, "src string, dst string, place int, text string")).count() == 0


def test_investigation_edges(spark):
    number = lambda t: F.regexp_extract(t, r"\b(\d{3})\b", 1)
    fields = [V.Field("company_size_tier", number, "/team", ("about_or_company", "careers_or_team", "search_size"), lambda t: F.regexp_extract(t, r"\b(\d\d)\b", 1)), V.Field("odd_field", number, "/x", ("a", "b", "c"))]
    sessions = [(1, "a.io", "has 123 people", False), (1, "a.io", "has 123 people", False), (2, "b.io", "only 45", False), (3, "c.io", None, False), (4, "d.io", "", False), (5, "e.io", "nothing", True), (6, "f.io", "nothing", None)]
    hits = [(3, 1, "https://x.io/news", "t", "says 777"), (3, 2, "https://x.io/about", None, "says 888"), (3, 9, "ftp://x.io/about", "", "999"), (4, 1, "https://linkedin.com/company", "", None), (4, 2, "https://p.io/about", "", "no"), (4, 2, "https://p.io/about", "", "no"), (5, 1, "https://p.io/about", "", "555")]
    pages = spark.createDataFrame([("https://linkedin.com/company", "111"), ("https://p.io/about", "page 222"), ("https://p.io/about", "page 222")], "url string, text string")
    out = V.investigate(spark.createDataFrame(sessions, "session_id int, domain string, text string, search_failed boolean"), spark.createDataFrame(hits, "session_id int, rank int, url string, title string, snippet string"), pages, fields)
    got = {(r.session_id, r.field): (r.strategy, r.value, r.source_url, r.status) for r in out.collect()}
    assert len(got) == 12 == out.count()
    size, odd = (lambda i: got[i, "company_size_tier"]), (lambda i: got[i, "odd_field"])
    assert size(1) == (1, "123", "https://a.io", "VERIFIED") and size(2) == (2, "45", "https://b.io/team", "VERIFIED")
    assert size(3) == odd(3) == (3, "888", "https://x.io/about", "VERIFIED") and size(4) == (4, "222", "https://p.io/about", "VERIFIED")
    assert size(5)[3] == "UNVERIFIED" and size(6)[3] == "NOT_FOUND_AFTER_SEARCH" and odd(6)[3] == odd(2)[3] == "UNVERIFIED"
