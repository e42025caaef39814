"""Quality rules by weak supervision, in DataFrame operations only.

Word and line statistics of whole texts give each rule's vote: good (1), bad (-1) or abstain (0). Documents fall into vote patterns, at most
3**rules of them, and expectation-maximisation runs on the pattern counts: each rule has a rate of voting good, bad and abstaining among good and
among bad documents, the classes have a prior, and the posterior of a pattern gives every document's quality probability. What comes
to the driver is one row of rates for each round.

Repeats in a document are found in its row: 3-word windows are hashed to 64 bits, sorted with their places, and equal neighbours mark
the words they cover, so a text of n words takes n log n steps and no shuffle.

Defined results: null text has no words and fails the base rules; null and repeated doc_id are rows of their own; an empty table gives an empty
result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.llm._common import body, cut

MIN_WORDS, MOST_REPEATED = 50, 0.5
ROUNDS = 15
KEEP = 0.5
#: Rates stay within these, so that no rule decides alone.
FLOOR, SMOOTH = 0.005, 1.0
PRIOR_GOOD = 0.8
#: Starting belief, by class (bad, good): how often a rule votes bad, abstains and votes good. Most rules name one kind of badness and
#: abstain on every other kind, so an abstention says little and a vote for bad says much.
START = ((0.3, 0.5, 0.2), (0.02, 0.48, 0.5))


SPACE = r"\x20\x09-\x0D"


def _less(text: Column, of: str) -> Column:
    """How many characters of text are in the class `of`, which no text is made of for the most part: runs of it are taken out."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, f"[{of}]+", ""))


def _repeated(h: Column) -> Column:
    """(hash, place) of all windows in order of hash, if any hash comes twice; else none."""
    return F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and further counts, over whole texts.

    A text is split once and thinned once, to what is neither a-z nor white space; the counts are made from the words and the thin text.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    d = d.select(
        "doc_id", "text",
        F.array_remove(F.split("text", f"[{SPACE}]+"), "").alias("w"),
        F.regexp_replace("text", f"[a-z{SPACE}]+", "").alias("thin"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"),
    )
    thin = F.col("thin")
    d = d.select(
        "doc_id", "text", "w",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _less(thin, "#*$%&|<>").cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace(thin, r"\p{L}+", "")).cast("long").alias("n_others"),
        _less(thin, "A-Z").cast("long").alias("n_upper"),
        _less(thin, "!?").cast("long").alias("n_shouts"),
        _less(thin, "0-9").cast("long").alias("n_digits"),
        (F.octet_length(thin) - F.octet_length(F.replace(thin, F.lit("."), F.lit("")))).cast("long").alias("n_stops"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_types"),
        F.expr("if(size(w) < 3, cast(array() as array<bigint>), transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))").alias("h"),
    )
    d = d.withColumns({
        "n_letters": F.col("word_chars") - F.col("n_others"),
        "n_symbol_ends": F.when(F.col("n_symbols") > 0, F.regexp_count("text", F.lit(f"[#*$%&|<>](?=[{SPACE}]|$)"))).otherwise(0).cast("long"),
        "s": _repeated(F.col("h")),
    }).drop("text", "w", "h", "n_others")
    same = "(k > 0 and s[greatest(k - 1, 0)].h = x.h) or (k + 1 < size(s) and s[least(k + 1, size(s) - 1)].h = x.h)"
    d = d.withColumn("m", F.sort_array(F.expr(f"filter(transform(s, (x, k) -> if({same}, x.i, -1)), i -> i >= 0)"))).drop("s")
    # each window covers up to three words, less what the next one covers
    covered = F.expr("aggregate(transform(m, (x, k) -> if(k + 1 < size(m), least(3, m[least(k + 1, size(m) - 1)] - x), 3)), 0L, (a, n) -> a + n)")
    return d.withColumn("n_repeat_words", covered).drop("m")


def votes() -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    size = F.col("word_chars") / n
    symbols, upper, shouts, digits = F.col("n_symbols") / n, F.col("n_upper") / chars, F.col("n_shouts") / n, F.col("n_digits") / chars
    repeats, types, stops = F.col("n_repeat_words") / n, F.col("n_types") / n, F.col("n_stops") / n

    def rule(bad: Column, good: Column | None = None) -> Column:
        out = F.when(F.col("n_words") == 0, 0).when(bad, -1)
        return (out if good is None else out.when(good, 1)).otherwise(0).cast("int")

    share = F.col("n_symbols") / chars
    return {
        "v_symbols": rule(symbols > 0.1),
        "v_symbol_share": rule(share > 0.05),
        "v_symbol_ends": rule(F.col("n_symbol_ends") / n > 0.1),
        "v_letters": rule(F.col("n_letters") / chars < 0.8, F.col("n_letters") / chars > 0.9),
        "v_upper": rule(upper > 0.4),
        "v_shouts": rule(shouts > 0.3),
        "v_repeats": rule(repeats > 0.2),
        "v_lines": rule(F.col("n_dup_lines") >= 3),
        "v_types": rule(types < 0.2),
        "v_word_size": rule((size < 2) | (size > 14), size.between(3, 10)),
        "v_digits": rule(digits > 0.2),
        "v_stops": rule((stops > 0.6) | (stops < 0.004), stops.between(0.01, 0.3)),
        "v_length": rule(F.col("n_words") < MIN_WORDS, F.col("n_words") >= 2 * MIN_WORDS),
    }


def em(patterns: DataFrame, rules: list[str], rounds: int = ROUNDS) -> tuple[float, dict[tuple[str, int, int], float]]:
    """patterns (the rules' votes, n), a small table -> the prior of good and, by (rule, class, vote), the rates. A round is one task."""
    patterns = patterns.coalesce(1)
    rate = {(r, c, v): START[c][v + 1] for r in rules for c in (0, 1) for v in (-1, 0, 1)}
    prior = PRIOR_GOOD
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), F.col(r).alias("vote")) for i, r in enumerate(rules)]))
    for _ in range(rounds):
        p = patterns.select("n", (F.col("n") * posterior(rules, prior, rate)).alias("good"), cells.alias("c"))
        got = {(r.rule, r.vote): (r.good, r.n) for r in p.groupBy("c.rule", "c.vote").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).collect()}  # 3 * rules rows at most
        if not got:
            break
        good, all_ = (sum(got.get((0, v), (0.0, 0))[k] for v in (-1, 0, 1)) for k in (0, 1))
        prior = min(max(good / all_, FLOOR), 1 - FLOOR)
        for i, r in enumerate(rules):
            for v in (-1, 0, 1):
                a, n = got.get((i, v), (0.0, 0))
                rate[r, 1, v] = max(FLOOR, (a + SMOOTH) / (good + 3 * SMOOTH))
                rate[r, 0, v] = max(FLOOR, (n - a + SMOOTH) / (all_ - good + 3 * SMOOTH))
    return prior, rate


def posterior(rules: list[str], prior: float, rate: dict) -> Column:
    """The probability of good, given the votes. The gains stand in one array, so that the generated code is the same in every round."""
    from math import log

    gains = F.array(*[F.lit(log(rate[r, 1, v] / rate[r, 0, v])) for r in rules for v in (-1, 0, 1)], F.lit(log(prior / (1 - prior))))
    odds = F.get(gains, F.lit(3 * len(rules)))
    for i, r in enumerate(rules):
        odds = odds + F.get(gains, F.col(r) + (3 * i + 1))
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame) -> DataFrame:
    """Statistics, votes, quality (posterior probability), base_failed and kept for each row of docs."""
    v = votes()
    rules = list(v)
    seen = cut(statistics(docs).withColumns(v), "weak-votes")
    patterns = cut(seen.groupBy(*rules).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "weak-patterns")
    prior, rate = em(patterns, rules)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * int(100 * MOST_REPEATED))
    out = seen.withColumn("quality", posterior(rules, prior, rate)).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP))


def op7(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"), *votes())
