"""I-Match fingerprints: terms of a band of inverse document frequency, sorted, hashed over randomised lexicon subsets. DataFrame operations only.

A term is a run of letters and digits of the lower-cased text, known by its 64-bit hash. Its document frequency is counted over all rows, by the last SLOT_BITS bits
of the hash (feature hashing), so that the counts and the lexicon have a bound whatever the vocabulary. The lexicon holds the terms with
LOW <= ln(documents / frequency) < HIGH. Every one of its places is in at least exp(-HIGH) of all documents, so it has at most exp(HIGH) times as many
places as a document has terms on average, some ten thousands; other terms fall into one of these by chance, one in 2**SLOT_BITS / size, the same ones in
every text. The lexicon goes to the tasks as one literal of 2**SLOT_BITS bytes (1 MB).

Subsets of the lexicon are drawn by bits of the terms' hashes: CHAINS chains of LEVELS subsets, the first one with a share of 2**-FIRST of the lexicon, each
other one with half of the one before. A slot of the fingerprint is
the hash of a document's sorted distinct terms in one subset. Slots of large subsets agree only for texts that are nearly equal; those of small subsets also
for texts that share less, and many short texts have no term in them. likeness() is the share of equal slots among those which either
text fills. The first slot is of the whole lexicon, or of the text itself where that has no term of the lexicon.

Texts travel once, to meet a start of the next one; all else is done where the text is.

Defined results: null text is empty; documents stand by falling doc_id, null last, rows with equal doc_id by their digests; repeated rows with equal doc_id
and text are one document there, each with its row; a single document is its own next; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leadlake.llm._common import body, cut, parts, tasks

#: The band: natural logarithms of documents / document frequency.
LOW, HIGH = 3.0, 6.0

#: Places that document frequencies are counted for.
SLOT_BITS = 20

#: Chains of subsets; half of them are drawn by a term's hash, half by a hash of that. FIRST + LEVELS - 1 bits serve a chain, the first BIT bits none.
CHAINS, LEVELS, FIRST, BIT = 10, 10, 3, 3

SLOTS = 1 + CHAINS * LEVELS

#: Hexadecimal digits of a slot; a slot of an empty subset shows dashes.
WIDTH = 3


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.array_distinct(F.transform(words, lambda t: F.xxhash64(t)))


def _place(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).cast("int")


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> bytes:
    """A character for each place: 1 for those of the terms of the band, else 0."""
    n = docs.count()
    places = F.array_distinct(F.transform(terms(body()), _place))
    found = docs.select(F.explode(places).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(n) / F.col("df"))
    out = bytearray(b"0" * (1 << SLOT_BITS))
    for row in found.where((idf >= low) & (idf < high)).select("p").collect():  # at most 2**SLOT_BITS numbers
        out[row["p"]] = ord("1")
    return bytes(out)


def kept(text: Column, words: bytes) -> Column:
    """The sorted hashes of the distinct terms of a text that the lexicon holds."""
    return F.sort_array(F.filter(terms(text), lambda h: F.substr(F.lit(words), _place(h) + 1, F.lit(1)) == F.lit(b"1")))


def _slot(hashes: Column) -> Column:
    digits = F.lpad(F.lower(F.hex(F.xxhash64(hashes).bitwiseAND(F.lit((1 << 4 * WIDTH) - 1)))), WIDTH, "0")
    return F.when(F.size(hashes) > 0, digits).otherwise("-" * WIDTH)


def fingerprint(text: Column, words: bytes) -> Column:
    def chain(all_: Column, c: int) -> Column:
        at = BIT + c * (FIRST + LEVELS - 1)
        first = F.filter(all_, lambda x: x.bitwiseAND(F.lit(((1 << FIRST) - 1) << at)) == 0)
        start = F.struct(first.alias("in"), F.lit("").alias("out"))
        half = lambda xs, s: F.filter(xs, lambda x: F.call_function("getbit", x, s) == 0)
        step = lambda acc, s: F.struct(half(acc["in"], s).alias("in"), F.concat(acc["out"], _slot(acc["in"])).alias("out"))
        return F.aggregate(F.sequence(F.lit(at + FIRST), F.lit(at + FIRST + LEVELS - 1)), start, step, lambda acc: acc["out"])

    def slots(xs: Column) -> Column:
        whole = F.when(F.size(xs) > 0, _slot(xs)).otherwise(_slot(F.array(F.xxhash64(text))))
        again = F.transform(xs, lambda x: F.xxhash64(x))
        return F.concat(whole, *[chain(xs, c) for c in range(CHAINS // 2)], *[chain(again, c) for c in range(CHAINS // 2)])

    # inside a lambda, so that the terms are found once
    return F.get(F.transform(F.array(kept(text, words)), slots), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Equal slots over slots that either fills."""
    each = lambda x: F.regexp_extract_all(x, F.lit("." * WIDTH), F.lit(0))
    verdict = lambda x, y: F.when(x != y, 1).when(x == "-" * WIDTH, 0).otherwise(2)
    seen = F.array_remove(F.zip_with(each(a), each(b), verdict), 0)
    return F.when(a == b, 1.0).otherwise(F.size(F.array_remove(seen, 1)) / F.size(seen))


def _rows(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    return rows.withColumn("key", F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2("text", 256)), 256)))


def ring(docs: DataFrame) -> DataFrame:
    """For each document (key) the next one's key by falling doc_id, and the key and length of the one before; the last and the first are neighbours."""
    keys = cut(_rows(docs).select("key", "doc_id", F.char_length("text").cast("long").alias("n_chars")).groupBy("key", "doc_id", "n_chars").agg(F.count(F.lit(1)).alias("copies")), "imatch-keys")
    ranged = keys.repartitionByRange(tasks(keys), F.col("doc_id").desc_nulls_last(), F.col("key")).sortWithinPartitions(F.col("doc_id").desc_nulls_last(), F.col("key"))
    order = cut(ranged.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")), "imatch-order")
    me = F.struct("key", "n_chars")
    within = W.partitionBy("part").orderBy("pos")
    # a row for each part: its first and last document, and those of its neighbours
    ends = order.groupBy("part").agg(F.min_by(me, "pos").alias("first"), F.max_by(me, "pos").alias("last"))
    over, all_ = W.orderBy("part"), W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = ends.select(
        "part", F.coalesce(F.lead("first").over(over), F.first("first").over(all_)).alias("after"), F.coalesce(F.lag("last").over(over), F.last("last").over(all_)).alias("before")
    )
    linked = order.withColumn("next", F.lead(me).over(within)).withColumn("prev", F.lag(me).over(within)).join(F.broadcast(ends), "part")
    return linked.select(
        "key", "doc_id", "copies", F.coalesce("next", "after").getField("key").alias("next_key"), F.coalesce("prev", "before").getField("key").alias("prev_key"),
        F.coalesce("prev", "before").getField("n_chars").alias("prev_chars"),
    )


def edited(docs: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, key, next_key, text, and edited: the last half of the text replaced by as much of the next document's start. links: ring(docs), written."""
    # many terms for each byte: dealt for good, so that tasks are not joined by the texts' size; both uses share the one exchange
    rows = _rows(docs).select("key", "text").repartition(parts(docs.sparkSession), "key")
    starts = rows.join(links.select("key", "prev_key", "prev_chars"), "key").select(F.col("prev_key").alias("key"), F.substr("text", F.lit(1), F.expr("cast(prev_chars div 2 as int)")).alias("start"))
    if not links.where("copies > 1").isEmpty():
        starts = starts.dropDuplicates(["key"])  # of repeated rows each gives its start
    both = rows.join(links.select("key", "doc_id", "next_key"), "key").join(starts, "key")
    size = F.char_length("text")
    return both.select("key", "next_key", "doc_id", "text", F.concat(F.substr("text", F.lit(1), size - F.floor(size / 2).cast("int")), F.col("start")).alias("edited"))


def op11(docs: DataFrame) -> DataFrame:
    words, links = lexicon(docs), cut(ring(docs), "imatch-ring")
    both = edited(docs, links).select(
        "key", "next_key", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text"), words).alias("fingerprint"), fingerprint(F.col("edited"), words).alias("edited_fingerprint"),
    )
    found = cut(both, "imatch-prints")
    nexts = found.select(F.col("key").alias("next_key"), F.col("fingerprint").alias("_next"))
    if not links.where("copies > 1").isEmpty():
        nexts = nexts.dropDuplicates(["next_key"])
    return found.join(nexts, "next_key").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next")).alias("near_next"),
    )
