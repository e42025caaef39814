"""Substring dedup by hashing lines or paragraphs.

Texts are cut into units: lines, and sentences inside lines, so that a passage put inside a line is seen too (or any others of lines, sentences
and paragraphs). A unit's normal form has A-Z lowered and white space collapsed; units without words take no part, nor do sentences of fewer than
MIN_WORDS words that are no lines of their own. The 128-bit digests of all units are grouped over the whole corpus, the occurrence with the least
(doc_id, text checksum, offset) stays, and every other one is removed. Offsets are code points of the original text, end exclusive. A unit
inside a removed one is removed with it: its first occurrence can't stand there, for the removed unit has an earlier copy that holds it too.

Only digests seen twice travel a second time: a bitmap of bounded size keeps the others where they are.

Defined results: null text has no units; a null doc_id ranks first; rows with one doc_id and one text are one document, whose units are not
each other's copies; an empty table gives an empty result; other columns are left alone by clean().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm._common import bitmap, body, cut, maybe_in, number, tasks

#: Sentences of fewer words are no units; lines and paragraphs need one word.
MIN_WORDS = 5
SPACE = r"\x20\x09-\x0D"
UNITS = ("line", "sentence")
#: Where a unit ends; the end belongs to the unit. Sentences end where lines do.
ENDS = {"sentence": rf"[.!?][{SPACE}]+|\n", "line": r"\n", "paragraph": rf"\n[{SPACE}]*\n"}
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _spans(text: str, units, ends: dict, min_words: int):
    """(start, end, words, digest) of the units, each span once, by unit, then place."""
    from hashlib import blake2b

    seen = set() if len(units) > 1 else None
    for unit in units:
        a, n = 0, len(text)
        floor = min_words if unit == "sentence" else 1
        borders = [m.end() for m in ends[unit](text)]
        if not borders or borders[-1] < n:
            borders.append(n)
        for z in borders:
            if seen is not None:
                if (a, z) in seen:
                    a = z
                    continue
                seen.add((a, z))
            w = text[a:z].encode().translate(_LOWER).split()
            if len(w) >= floor:
                yield a, z, len(w), blake2b(b" ".join(w), digest_size=16).digest()
            a = z


def _splitter(units, min_words: int):
    def run(batches):
        import re

        import pyarrow as pa

        ends = {u: re.compile(ENDS[u]).finditer for u in units}
        for b in batches:
            ids, crcs = b.column("doc_id"), b.column("text_crc32")
            doc, start, stop, words, his, los = [], [], [], [], [], []

            def flush(ids=ids, crcs=crcs):
                nonlocal doc, start, stop, words, his, los
                at = pa.array(doc, pa.int64())
                out = pa.RecordBatch.from_arrays(
                    [ids.take(at), crcs.take(at), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(words, pa.int32()), pa.array(his, pa.int64()), pa.array(los, pa.int64())],
                    names=["doc_id", "text_crc32", "start", "end", "n_words", "hi", "lo"],
                )
                doc, start, stop, words, his, los = [], [], [], [], [], []
                return out

            for i, t in enumerate(b.column("text")):
                for a, z, n, d in _spans(t.as_py(), units, ends, min_words):
                    doc.append(i)
                    start.append(a)
                    stop.append(z)
                    words.append(n)
                    his.append(int.from_bytes(d[:8], "little", signed=True))
                    los.append(int.from_bytes(d[8:], "little", signed=True))
                    if len(doc) >= 50_000:
                        yield flush()
            if doc:
                yield flush()

    return run


def repeats(docs: DataFrame, units: tuple[str, ...] = UNITS, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each unit that goes: doc_id, text_crc32, start, end, n_words, and the occurrence that stays (keep_doc_id, keep_start)."""
    rows = docs.select(number().alias("doc_id"), body().alias("text"))
    rows = rows.withColumn("text_crc32", F.crc32("text"))
    schema = "doc_id long, text_crc32 long, start int, end int, n_words int, hi long, lo long"
    all_ = cut(rows.mapInArrow(_splitter(units, min_words), schema), "line-units")
    first = F.min(F.struct("doc_id", "text_crc32", "start")).alias("first")
    twice = cut(all_.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1").drop("n"), "line-twice", tasks(all_))
    some = maybe_in(all_, "hi", bitmap(twice, "hi"))
    found = some.join(twice, ["hi", "lo"]).where("not (doc_id <=> first.doc_id and text_crc32 = first.text_crc32 and start = first.start)")
    return found.select("doc_id", "text_crc32", "start", "end", "n_words", F.col("first.doc_id").alias("keep_doc_id"), F.col("first.start").alias("keep_start"))


def _without(batches):
    import pyarrow as pa

    for b in batches:
        texts = []
        for t, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            if spans and t is not None:
                at, out = 0, []
                for s in sorted((s["start"], s["end"]) for s in spans):
                    if s[0] > at:
                        out.append(t[at : s[0]])
                    at = max(at, s[1])
                t = "".join([*out, t[at:]])
            texts.append(t)
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string())], names=["row", "text"])


def clean(docs: DataFrame, units: tuple[str, ...] = UNITS, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the repeated units taken out of text; other columns stay."""
    spans = repeats(docs, units, min_words).distinct().groupBy(F.col("doc_id").alias("id"), F.col("text_crc32").alias("crc")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = cut(spans, "line-spans")
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    rows = docs.select(others.alias("row"), number().alias("own"), F.crc32(body()).alias("own_crc"), F.col("text").cast("string").alias("text"))
    out = rows.join(spans, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_crc") == F.col("crc")), "left").select("row", "text", "spans")
    out = out.mapInArrow(_without, out.drop("spans").schema)
    return out.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op8(docs: DataFrame) -> DataFrame:
    """No contract fixes op8: one row for each removed unit, so that documents without repeats do not appear."""
    return repeats(docs).drop("text_crc32")


SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, t, 1 AS least, string_split(regexp_replace(t, '(\n)', '\1' || chr(1), 'g'), chr(1)) AS us FROM d
      UNION ALL SELECT doc_id, t, 5, string_split(regexp_replace(t, '([.!?][\x20\x09-\x0D]+|\n)', '\1' || chr(1), 'g'), chr(1)) FROM d),
e AS (SELECT doc_id, t, least, unnest(us) AS x, unnest(generate_series(1, len(us))) AS k FROM p),
o AS (SELECT doc_id, t, least, x, CAST(sum(length(x)) OVER (PARTITION BY doc_id, t, least ORDER BY k) - length(x) AS INTEGER) AS start,
             trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM e),
w AS (SELECT DISTINCT doc_id, t, start, CAST(start + length(x) AS INTEGER) AS "end", norm, CAST(len(string_split(norm, ' ')) AS INTEGER) AS n_words
      FROM o WHERE norm <> '' AND len(string_split(norm, ' ')) >= least),
f AS (SELECT *, first_value(doc_id) OVER r AS keep_doc_id, first_value(start) OVER r AS keep_start, row_number() OVER r AS k FROM w
      WINDOW r AS (PARTITION BY norm ORDER BY doc_id, start))
SELECT doc_id, start, "end", n_words, keep_doc_id, keep_start FROM f WHERE k > 1
"""
