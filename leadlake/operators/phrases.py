"""Phrases of one word or more looked for in texts: a join, so that the cost does not grow with the list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def phrase_hits(texts: DataFrame, phrases: DataFrame, key: str, text: str, phrase: str, most: int = 8) -> DataFrame:
    """A row for each place (position of its first word) where a phrase stands in a text, as whole words: key, the columns of phrases, position.

    Each word of a text meets the phrases that begin with it, by an equi-join that the planner may broadcast; the words after it, as many as the longest
    phrase has, are then compared. Repeated phrases count once; phrases without a word, or of more than `most` words, are an error of the caller's table
    and are in no text. Null texts and keys hold nothing, or are keys like others."""
    p = phrases.distinct().withColumn("_t", tokens(F.col(phrase))).where(F.size("_t").between(1, most))
    p = p.withColumn("_first", F.get("_t", F.lit(0))).withColumn("_said", F.concat(F.array_join("_t", " "), F.lit(" "))).drop("_t")
    longest = p.agg(F.coalesce(F.max(F.size(F.split("_said", " "))) - 1, F.lit(1)).alias("n")).head()["n"]
    at = F.sequence(F.lit(1), F.size("_w"))
    grams = F.when(F.size("_w") > 0, F.transform(at, lambda i: F.struct((i - 1).alias("position"), F.concat(F.array_join(F.slice("_w", i, longest), " "), F.lit(" ")).alias("said"))))
    words = texts.select(F.col(key).alias("_key"), tokens(F.col(text)).alias("_w")).select("_key", F.explode(grams).alias("g"))
    met = words.select("_key", "g.position", F.col("g.said").alias("_next"), F.substring_index("g.said", " ", 1).alias("_first")).join(p, "_first")
    return met.where(F.startswith("_next", F.col("_said"))).select(F.col("_key").alias(key), *phrases.columns, "position")
