"""First-match rule ladders: ordered (rule, predicate, reason) folded to one struct, the first hit wins."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlake.functions.url import quoted


class Rule(NamedTuple):
    id: str
    hit: Column
    reason: Column | str


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value made once, however often body looks at it. It is evaluated as a lambda, so it can't outgrow a JVM method."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(rules: Iterable[Rule]) -> Column:
    """struct(keep, rule_id, reason) of the first rule that hits. Rules after it are not evaluated, reasons only for it."""
    rules = list(rules)
    place = F.lit(0)
    for n in range(len(rules), 0, -1):
        place = F.when(rules[n - 1].hit, n).otherwise(place)
    reasons = [F.lit(r.reason) if isinstance(r.reason, str) else r.reason for r in rules]

    def verdict(at: Column) -> Column:
        reason = F.lit("OK")
        for n in range(len(rules), 0, -1):
            reason = F.when(at == n, reasons[n - 1]).otherwise(reason)
        ids = F.array(F.lit("OK"), *[F.lit(r.id) for r in rules])
        return F.struct((at == 0).alias("keep"), F.get(ids, at).alias("rule_id"), F.coalesce(reason, F.lit("OK")).alias("reason"))

    return let(place, verdict)


def says(text: str, *values: Column) -> Column:
    """text with %s in place of the values."""
    return F.format_string(text, *values)


def first_of(c: Column, patterns: list[str]) -> Column:
    """What the first match of any of the patterns is, null if none matches: one pass over the text."""
    found = F.regexp_extract(c, f"({'|'.join(f'(?:{p})' for p in patterns)})", 1)
    return F.when(found != "", found)


def first_word(c: Column, words: list[str]) -> Column:
    return first_of(c, [quoted([w]) for w in words])
