"""Connected components over edges between longs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm._common import cut, tasks, tidy


@tidy
def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """edges (a, b), a written table -> (v, comp) for each vertex of an edge; comp is the least vertex of its component.

    Least labels spread to neighbours and then jump to their label's label, so that the rounds grow with the logarithm of a chain's length.
    Each round is a written table; what comes to the driver is one count. Defined results: repeated edges and loops change nothing, a vertex that
    only loops has no row, null ends make no edge, no edges give no rows.
    """
    edges = edges.select("a", "b")
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges", 2 * tasks(edges))
    n = tasks(both)
    both = both.coalesce(n)
    labels = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("comp")), f"{name}-labels", n)
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("comp").alias("near")).withColumnRenamed("a", "v")
        spread = labels.withColumnRenamed("comp", "old").join(near, "v").withColumn("comp", F.least("old", "near")).drop("near")
        spread = cut(spread, f"{name}-spread", n)
        up = spread.select(F.col("v").alias("comp"), F.col("comp").alias("up"))
        after = cut(spread.join(up, "comp").select("v", "old", F.col("up").alias("comp")), f"{name}-labels", n)
        labels = after.select("v", "comp")
        if after.where("comp <> old").isEmpty():
            return labels
