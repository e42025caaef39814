"""Personal data: fixed base patterns, and bootstrapped contextual extraction of what they miss.

One pass over whole texts finds, for each kind, the base spans (the seeds), candidates (looser shapes of the kind that the base does not
take) and rivals (other words with digits or @), each with its lexical patterns: the words just before and after, digits folded. Spark then
scores the graph of patterns and instances in rounds: believed instances make patterns trusted, trusted patterns make candidates believed, and these
support further patterns in the next round, until a round adds nothing. A believed instance is a span wherever it stands.

Defined results: null text is empty; null or repeated doc_id are rows of their own; base spans of different kinds may overlap, found spans
overlap nothing; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm._common import body, cut, tasks

KINDS = ("email", "ip", "card", "phone")
#: A pattern needs this many different believed instances and, as a candidate does, this worth.
MIN_SEEDS, BELIEF = 5, 0.8

#: The base patterns' character classes.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
SPACE = " \t\n\r\x0b\x0c"


def _rx():
    import re

    return {
        "domain": re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        "ip": re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),  # a match begins at the start of a run of digits, always
        "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
        "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
        "digits": re.compile(r"[0-9]+"),
        "any": re.compile(r"[0-9@]|\bdot\b|\[dot\]|\(dot\)", re.IGNORECASE),
        # looser shapes: numbers in groups or in one run, spelt-out addresses, addresses without a dot, octets set apart; a local part has at most
        # 64 characters and a label 63, as the mail standards have it
        "like_phone": re.compile(r"(?<![0-9A-Za-z+])(?:\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,5}\)?){1,5}|[0-9]{9,15})(?![0-9A-Za-z])"),
        "like_card": re.compile(r"(?<![0-9A-Za-z])[0-9]{3,4}(?:[\x20./_-]{1,2}[0-9]{3,6}){2,5}(?![0-9A-Za-z])"),
        "like_ip": re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\x20?\.\x20?|\[\.\]|\(\.\))[0-9]{1,3}(?:\x20?\.\x20?|\[\.\]|\(\.\))[0-9]{1,3}(?:\x20?\.\x20?|\[\.\]|\(\.\))[0-9]{1,3}(?![0-9A-Za-z])"),
        "like_email": re.compile(
            r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,64}(?:\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]{2,64}){0,4}"
            r"|\x20at\x20[A-Za-z0-9-]{1,64}(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]{2,64}){1,4})(?![A-Za-z0-9@])",
            re.IGNORECASE,
        ),
        "token": re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*"),
    }


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str, rx: dict) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base, by kind, then start."""
    out = []
    floor, at = 0, text.find("@")
    while at >= 0:
        start = floor + len(text[floor:at].rstrip(LOCAL))
        m = rx["domain"].match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            floor = m.end()
            at = text.find("@", floor)
        else:
            floor = at + 1  # @ is in no local part
            at = text.find("@", floor)
    if not rx["digits"].search(text):
        return out
    for m in rx["ip"].finditer(text):
        if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in rx["card"].finditer(text):
        if 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in rx["phone"].finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


def _plausible(kind: int, s: str) -> bool:
    digits = [c for c in s if c in "0123456789"]
    if kind == 0:
        return "dot" in s.lower() or "." in s or "@" in s
    if kind == 1:
        import re

        return all(int(p) <= 255 for p in re.findall("[0-9]+", s))
    return 13 <= len(digits) <= 19 if kind == 2 else 9 <= len(digits) <= 15


def _short(s: str) -> str:
    """s itself, or a digest of the whole of it if it is long: no two long ones become one, and rows stay small."""
    import hashlib

    return s if len(s) <= 64 else "#" + hashlib.blake2b(s.encode(), digest_size=16).hexdigest()


def _whole_words(text: str, at: int, most: int, before: bool) -> list[str]:
    """The nearest words (runs without white space) before or after a place, however long they are."""
    size = 120
    while True:
        piece = text[max(0, at - size) : at] if before else text[at : at + size]
        words = piece.split()
        if len(piece) < size or len(words) > most or (len(words) == most and (piece[:1] if before else piece[-1:]).isspace()):
            return words[-most:] if before else words[:most]
        size *= 4


def _context(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a place: the two words before, the word before, the words around; digits folded, borders marked."""
    import re

    def tidy(w: str) -> str:
        return _short(re.sub("[0-9]+", "0", w.lower()))

    left = _whole_words(text, start, 2, True)
    right = _whole_words(text, end, 1, False)
    one, two = (tidy(left[-1]) if left else "^"), (tidy(left[-2]) if len(left) > 1 else "^")
    after = tidy(right[0]) if right else "$"
    return [f"{two} {one} _", f"{one} _", f"{one} _ {after}"]


class _Taken:
    """Disjoint spans in order; spans that overlap are one."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, z in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], z)
            else:
                self.starts.append(a)
                self.ends.append(z)

    def free(self, a: int, z: int) -> bool:
        import bisect

        i = bisect.bisect_left(self.starts, z)
        return i == 0 or self.ends[i - 1] <= a

    def add(self, a: int, z: int) -> None:
        import bisect

        i = bisect.bisect_left(self.starts, z)
        self.starts.insert(i, a)
        self.ends.insert(i, z)


def places(text: str, rx: dict, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, what): what is 1 for seeds, 0 for candidates, -1 for rivals (kind -1). Candidates and rivals overlap nothing."""
    out = [(k, a, z, 1) for k, a, z in base]
    taken = _Taken([(a, z) for _, a, z in base])
    for kind, name in ((0, "like_email"), (1, "like_ip"), (2, "like_card"), (3, "like_phone")):
        for m in rx[name].finditer(text):
            a, z = m.span()
            if taken.free(a, z) and _plausible(kind, m[0]):
                out.append((kind, a, z, 0))
                taken.add(a, z)
    for m in rx["token"].finditer(text):
        if taken.free(*m.span()):
            out.append((-1, *m.span(), -1))
    return out


def _finder(batches):
    import hashlib

    import pyarrow as pa
    from pyspark import TaskContext

    rx, part, seq = _rx(), TaskContext.get().partitionId(), 0
    place = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("what", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))
    for b in batches:
        counts, base_text, shas, found = [[], [], [], []], [], [], []
        for t in b.column("text"):
            text = t.as_py()
            base, more = [], []
            if rx["any"].search(text):
                base = base_spans(text, rx)
                more = [{"kind": k, "start": a, "end": z, "what": w, "instance": _short(text[a:z].lower()), "patterns": _context(text, a, z)} for k, a, z, w in places(text, rx, base)]
            for k in range(4):
                counts[k].append(sum(x[0] == k for x in base))
            said = ",".join(f"{KINDS[k]}:{a}:{z}" for k, a, z in base)
            base_text.append(said)
            shas.append(hashlib.sha256(said.encode()).hexdigest())
            found.append(more)
        n = b.num_rows
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([(part << 40) + seq + i for i in range(n)], pa.int64()), *[pa.array(c, pa.int64()) for c in counts], pa.array(base_text), pa.array(shas), pa.array(found, place)],
            names=["doc_id", "row", *[f"n_{k}" for k in KINDS], "base", "base_sha256", "places"],
        )
        seq += n


def scan(docs: DataFrame) -> DataFrame:
    """Base spans of each row of docs and the places that the bootstrap works on, without texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    schema = "doc_id long, row long, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, places array<struct<kind:int,start:long,end:long,what:int,instance:string,patterns:array<string>>>"
    return cut(rows.mapInArrow(_finder, schema), "pii-scan")


def bootstrap(scanned: DataFrame) -> DataFrame:
    """row, kind, start, end of the candidates that the bootstrap believes.

    An edge is a place: (kind, instance, pattern, n). In each round the instances believed so far, seeds first, support their patterns; a pattern is
    worth the share of believed occurrences among them and those that tell against it (rivals, seeds of other kinds), and is trusted from MIN_SEEDS
    different believed instances and a worth of BELIEF on. A candidate is believed if it stands in a trusted pattern and the mean worth of all its
    occurrences that any evidence speaks about is BELIEF or more. Belief is never taken back, so the rounds end; they do when one adds nothing.
    """
    occ = cut(scanned.select("row", F.explode("places").alias("p")).select("row", "p.*"), "pii-places")
    n = tasks(occ)
    seen = occ.withColumn("pattern", F.explode("patterns"))
    edges = cut(seen.where("what >= 0").groupBy("kind", "instance", "pattern").agg(F.count(F.lit(1)).alias("n"), F.max("what").alias("what")), "pii-edges", n)
    rivals = seen.where("what = -1").groupBy("pattern").agg(F.count(F.lit(1)).alias("rivals"))
    # only patterns that candidates stand in, or what they may come to stand in, matter
    live = edges.where("what = 0").select("pattern").distinct()
    edges = cut(edges.join(live, "pattern", "left_semi"), "pii-live-edges", n)
    rivals = cut(rivals.join(live, "pattern", "left_semi"), "pii-rivals", n)
    seeds = edges.where("what = 1").groupBy("pattern", "kind").agg(F.sum("n").alias("n"))
    all_seeds = seeds.groupBy("pattern").agg(F.sum("n").alias("all"))
    others = seeds.join(all_seeds, "pattern").select("pattern", "kind", (F.col("all") - F.col("n")).alias("others"))
    against = cut(
        edges.select("kind", "pattern").distinct().join(rivals, "pattern", "left").join(all_seeds, "pattern", "left").join(others, ["pattern", "kind"], "left")
        .select("kind", "pattern", (F.coalesce("rivals", F.lit(0)) + F.coalesce("others", "all", F.lit(0))).alias("against")),
        "pii-against", n,
    )
    candidates = cut(edges.where("what = 0").select("kind", "instance").distinct(), "pii-candidates", n)
    believed = cut(edges.where("what = 1").select("kind", "instance").distinct(), "pii-seeds", n)
    known, turn = believed.count(), 0
    while True:
        support = edges.join(believed, ["kind", "instance"], "left_semi").groupBy("kind", "pattern").agg(F.sum("n").alias("pos"), F.count(F.lit(1)).alias("instances"))
        worth = against.join(support, ["kind", "pattern"], "left").withColumn("pos", F.coalesce("pos", F.lit(0))).where("pos + against > 0")
        worth = worth.select("kind", "pattern", (F.col("pos") / (F.col("pos") + F.col("against"))).alias("worth"), (F.coalesce("instances", F.lit(0)) >= MIN_SEEDS).alias("firm"))
        worth = cut(worth, f"pii-worth-{turn}", n)
        held = edges.join(candidates, ["kind", "instance"], "left_semi").join(worth, ["kind", "pattern"])
        good = held.groupBy("kind", "instance").agg((F.sum(F.col("n") * F.col("worth")) / F.sum("n")).alias("belief"), F.bool_or(F.col("firm") & (F.col("worth") >= BELIEF)).alias("firm"))
        good = good.where((F.col("belief") >= BELIEF) & F.col("firm")).select("kind", "instance")
        believed = cut(believed.union(good).distinct(), f"pii-believed-{turn}", n)
        now, turn = believed.count(), turn + 1
        if now == known:
            break
        known = now
    return occ.where("what = 0").join(believed, ["kind", "instance"], "left_semi").select("row", "kind", "start", "end")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base by kind, base, base_sha256, spans (base and found) and n_found for each row of docs."""
    scanned = scan(docs)
    more = bootstrap(scanned).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    own = F.expr("transform(filter(places, x -> x.what = 1), x -> struct(x.kind as kind, x.start as start, x.end as end))")
    all_ = F.array_sort(F.concat(own, F.coalesce("more", F.expr("cast(array() as array<struct<kind:int,start:long,end:long>>)"))))
    names = F.array(*map(F.lit, KINDS))
    said = F.array_join(F.transform(all_, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    return scanned.join(more, "row", "left").select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", said.alias("spans"), F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_found"))


def op2(docs: DataFrame) -> DataFrame:
    return find(docs)
