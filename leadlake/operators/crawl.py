"""Bounded crawls of many sites at once: each round takes the best waiting page of every site, until its budget is spent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadlake.functions import url as U
from leadlake.operators.relational import first_of
from leadlake.session import kept


def crawl(seeds: DataFrame, links: DataFrame, max_pages: int = 4, max_depth: int = 2, noise: int = 5) -> DataFrame:
    """seeds (site, url) and links (src, dst, place, text) -> site, url, depth, score, turn of the pages that are visited, in their turn.

    A site's queue is ordered by link score (0 read first, 2 noise), depth, and the order of arrival. A page's links, by place, join the queue
    if they stay on the site, are neither visited nor waiting, and are no more than `noise` of score 2 from one page; none join from max_depth on,
    nor once visited and waiting pages are max_pages. So each turn depends on the ones before it: the loop is over turns, max_pages at most, each one equi-joins
    over all sites together, its table written. Of a site's seeds the first by url counts; null urls, sites and links are left out; of equal links the first in place."""
    first = seeds.where("site is not null and url is not null").groupBy("site").agg(F.min("url").alias("url"))
    columns = ["site", "url", "home", "score", "depth", "round", "place", "turn"]
    zero = F.lit(0)
    seen = first.select("site", "url", F.col("url").alias("home"), zero.alias("score"), zero.alias("depth"), zero.alias("round"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("int").alias("turn"))
    seen = kept(seen, "crawl-0")
    edges = links.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.min_by("text", "place").alias("text"), F.min("place").cast("long").alias("place"))
    for turn in range(1, max_pages + 1):
        waiting = seen.where("turn is null")
        picks = first_of(waiting, ["site"], ["score", "depth", "round", "place", "url"], 1)
        size = seen.groupBy("site").agg(F.count(F.lit(1)).alias("known"))
        # pages that may still add to their queue
        open_ = picks.where(F.col("depth") < max_depth).join(size.where(F.col("known") < max_pages), "site").select("site", "home", F.col("url").alias("src"), (F.col("depth") + 1).alias("depth"))
        out = open_.join(edges, "src").where(U.same_site(F.col("dst"), F.col("home"))).select("site", F.col("dst").alias("url"), "home", U.link_score(F.col("dst"), F.coalesce("text", F.lit(""))).alias("score"), "depth", "place")
        out = out.join(seen.select("site", "url"), ["site", "url"], "left_anti").withColumn("_n", F.row_number().over(W.partitionBy("site", F.col("score") == 2).orderBy("place", "url")))
        fresh = out.where((F.col("score") < 2) | (F.col("_n") <= noise)).withColumn("round", F.lit(turn)).withColumn("turn", F.lit(None).cast("int"))
        chosen = picks.select("site", "url", F.lit(turn).alias("_turn"))
        marked = seen.join(chosen, ["site", "url"], "left").withColumn("turn", F.coalesce("turn", "_turn"))
        seen = kept(marked.select(*columns).unionByName(fresh.select(*columns)), f"crawl-{turn}")
        if seen.where("turn is null").isEmpty():
            break
    return seen.where("turn is not null").select("site", "url", "depth", "score", "turn")
