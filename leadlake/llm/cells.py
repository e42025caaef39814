"""Joins of large buckets: each bucket is a grid of cells of bounded size, so that no task compares a whole bucket.

Defined results: those of the plain join. Null keys meet nothing; repeated rows meet as often as they come; empty sides give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.llm._common import cut, parts

#: Rows of each side that meet in one cell, about. It moves work between tasks, never results.
SIDE = 8192


def _line(by: str, many: str) -> Column:
    return F.pmod(F.xxhash64(by), F.col(many))


def meet(left: DataFrame, right: DataFrame, key: list[str], by: tuple[str, str], on: Column, name: str, files: int | None = None) -> DataFrame:
    """left and right (whose other columns have different names) joined on the columns `key` and the condition `on`. Of a key with L and R rows the
    left ones are dealt to about L / SIDE lines, the right ones to R / SIDE columns of a grid, by a hash of `by`, a column of each side that tells rows
    of one key apart. A left row is sent to each cell of its line, a right row to each of its column: every pair meets once, in one cell."""
    count = lambda df, c: df.groupBy(*key).agg(F.count(F.lit(1)).alias(c))
    grid = count(left, "_l").join(count(right, "_r"), key).where((F.col("_l") > SIDE) | (F.col("_r") > SIDE))
    grid = cut(grid.select(*key, *[F.ceil(F.col(c) / SIDE).alias(m) for c, m in (("_l", "_lines"), ("_r", "_columns"))]), f"{name}-grid", files)
    if grid.isEmpty():
        return left.join(right, key).where(on)
    one = F.lit(1).cast("long")

    def dealt(df: DataFrame, own: str, own_many: str, other: str, other_many: str, column: str) -> DataFrame:
        sized = df.join(grid, key, "left").withColumns({m: F.coalesce(m, one) for m in ("_lines", "_columns")})
        sent = sized.withColumn(own, _line(column, own_many)).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other_many) - 1)))
        # a number of partitions that is asked for is not lowered at run time: many cells are little to read and much to compare
        return sent.drop("_lines", "_columns").repartition(parts(df.sparkSession), *key, "_line", "_column")

    a = dealt(left, "_line", "_lines", "_column", "_columns", by[0])
    b = dealt(right, "_column", "_columns", "_line", "_lines", by[1])
    return a.join(b, [*key, "_line", "_column"]).where(on).drop("_line", "_column")
