import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, key string, part int, fp string"


def _prose(rng, n):
    return " ".join("".join(rng.choice(["re", "an", "th", "on", "é", "is"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, copies, near copies, a hot source."""
    rng = random.Random(5)
    row = lambda i, t, lang="en", source="s0": (i, t, lang, source, len(t or ""), 0.5, "k", "x", 1, "f")
    out = [row(None, "text without an id here at all"), row(1, None), row(2, ""), row(3, " \t\n "), row(4, "word"), row(5, "a b c"), (6, None, None, None, None, None, None, None, None, None)]
    long = _prose(rng, 9000)
    out += [row(7, long, "fr", "s1"), row(8, long + " end", "fr", None), row(9, "x" * 20000, None, "s2")]
    same = _prose(rng, 120)
    out += [row(10 + i, same, "en", "s0") for i in range(12)]
    out += [row(30, same), row(30, same)]  # a repeated row
    base = _prose(rng, 400).split(" ")
    for i in range(10):
        near = list(base)
        near[37 * i % 400] = "changed"
        out.append(row(40 + i, " ".join(near), "de", "s3"))
    out += [row(60 + i, _prose(rng, rng.randint(1, 300)), rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s4", "é", None])) for i in range(40)]
    out += [row(120, "Loop it. " * 200), row(121, "SHOUT!! NOW!! " * 90), row(122, "<|endoftext|> it's a\x00b ½   Ⅷ"), row(123, "日本語 テスト 😀")]
    return out


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
