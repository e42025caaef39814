"""Queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadlake.functions import facts as E
from leadlake.functions import text as X
from leadlake.functions import url as U
from leadlake.operators import filters as R
from leadlake.operators import phrases as P
from leadlake.operators import relational as J
from leadlake.operators import scores as S
from leadlake.plans.pages import _category, _listed, _rx
from leadlake.plans.registry import query
from leadlake.sources.writers import content_path

#: A small example of the sector dimension, which is a parameter of the operators.
SECTORS = {"energy": ["and", "ing", "the"], "media": ["de", "la", "que"], "law": ["der", "die", "und"]}


@query("document_safety", f"SELECT doc_id, {_category('text')} AS category FROM documents")
def document_safety(t):
    return t("documents").select("doc_id", R.disallowed_category(F.col("text")).alias("category"))


@query("document_moderation", f"SELECT source, count(*) AS documents, CAST(count(*) FILTER (WHERE ({_category('text')}) IS NOT NULL) AS BIGINT) AS quarantined FROM documents GROUP BY source")
def document_moderation(t):
    """Routing by the moderation rules, counted by source."""
    m = R.moderation_route(R.moderate(F.col("text")))
    return t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(m == "QUARANTINE_AND_BLOCK").alias("quarantined"))


_MAILS = r"list_distinct(list_filter(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'), lambda e: NOT regexp_matches(lower(e), 'example\.com|domain\.com|wixpress|sentry')))"


@query(
    "document_contacts",
    rf"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{{2,}}')) AS INTEGER) AS n_mails, CAST(least(3, len({_MAILS})) AS INTEGER) AS company_mails,
  CASE WHEN length(regexp_replace(ph, '[^0-9]', '', 'g')) BETWEEN 8 AND 15 THEN trim(ph) END AS phone
FROM (SELECT *, regexp_extract(text, '(\+?[0-9][0-9 \t\n\r().\-]{{6,}}[0-9])', 1) AS ph FROM documents)""",
)
def document_contacts(t):
    d = t("documents")
    n = F.size(F.regexp_extract_all("text", F.lit(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"), F.lit(0)))
    return d.select("doc_id", n.alias("n_mails"), F.size(E.prose_mails(F.col("text"))).alias("company_mails"), E.phone(F.col("text")).alias("phone"))


@query("document_words", r"SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS INTEGER) AS words, CAST(length(text) AS INTEGER) AS chars FROM documents")
def document_words(t):
    return t("documents").select("doc_id", X.words_split(F.col("text")).alias("words"), F.length("text").alias("chars"))


@query("document_chunks", "SELECT doc_id, CAST(k AS INTEGER) AS chunk_index, CAST(length(substring(text, k * 3000 + 1, 3000)) AS INTEGER) AS chunk_chars FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 3000.0) AS BIGINT))) AS k FROM documents WHERE length(text) > 0)")
def document_chunks(t):
    """Texts in pieces of 3000 characters."""
    c = t("documents").select("doc_id", F.explode(X.chunks(F.col("text"))).alias("c"))
    return c.select("doc_id", F.col("c.chunk_index").alias("chunk_index"), F.length("c.chunk").alias("chunk_chars"))


@query("document_store", "SELECT 'processed/text/' || sha256(text) || '.txt' AS path, count(*) AS documents, min(doc_id) AS first_doc FROM documents GROUP BY text")
def document_store(t):
    """Content-addressed paths: equal texts are stored once."""
    return t("documents").groupBy(content_path(F.col("text"), "text").alias("path")).agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc"))


@query("document_upsert", "SELECT md5(text) AS text_key, doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS k FROM documents) WHERE k = 1")
def document_upsert(t):
    """The newest row of each text, as an upsert by that key leaves it."""
    d = t("documents").select(F.md5(F.col("text").cast("binary")).alias("text_key"), "doc_id", "source")
    return J.latest_by(d, ["text_key"], ["doc_id"])


@query("source_rollup", "SELECT source, lang, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(n_chars), 2) AS mean_chars, max(n_chars) AS longest FROM documents GROUP BY source, lang")
def source_rollup(t):
    return t("documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 2).alias("mean_chars"), F.max("n_chars").alias("longest"))


_VALUES = ", ".join(f"('{s}', {i}, '{w}')" for i, (s, ws) in enumerate(SECTORS.items()) for w in ws)


@query(
    "document_sectors",
    f"""
WITH k(sector, place, word) AS (VALUES {_VALUES}), w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS word FROM documents),
s AS (SELECT doc_id, sector, place, count(*) AS score FROM w JOIN k USING (word) GROUP BY ALL)
SELECT doc_id, arg_max(sector, score * 10 - place) AS sector, max(score) AS score, CAST(sum(score) AS BIGINT) AS total FROM s GROUP BY doc_id""",
)
def document_sectors(t):
    """Sector by words: tokens joined to a small word table, so the cost does not grow with the number of words looked for."""
    d = t("documents")
    words = [(s, i, w) for i, (s, ws) in enumerate(SECTORS.items()) for w in ws]
    dim = d.sparkSession.createDataFrame(words, "sector string, place int, word string")
    tokens = d.select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("word"))
    s = tokens.join(F.broadcast(dim), "word").groupBy("doc_id", "sector", "place").agg(F.count(F.lit(1)).alias("score"))
    return s.groupBy("doc_id").agg(F.max_by("sector", F.col("score") * 10 - F.col("place")).alias("sector"), F.max("score").alias("score"), F.sum("score").alias("total"))


@query("label_review", f"""SELECT quality, toxic, count(*) AS documents, CAST(count(*) FILTER (WHERE ({_category('text')}) IS NOT NULL) AS BIGINT) AS flagged, CAST(sum(n_chars) AS BIGINT) AS chars
FROM documents JOIN labels USING (doc_id) GROUP BY quality, toxic""")
def label_review(t):
    """How the rules meet the labels."""
    j = t("documents").join(t("labels"), "doc_id")
    return j.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("documents"), F.count_if(R.disallowed_category(F.col("text")).isNotNull()).alias("flagged"), F.sum("n_chars").alias("chars"))


@query("unlabelled_documents", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlabelled_documents(t):
    return t("documents").select("doc_id", "source").join(t("labels").select("doc_id"), "doc_id", "left_anti")


@query("latest_turns", "SELECT conv_id, turn, role, CAST(length(text) AS INTEGER) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k = 1")
def latest_turns(t):
    """The last turn of each conversation."""
    c = t("conversations").select("conv_id", "turn", "role", F.length("text").alias("chars"))
    return J.latest_by(c, ["conv_id"], ["turn"])


@query("transcripts", "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def transcripts(t):
    """A timeline of roles for each conversation."""
    g = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"), F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"))
    return g.select("conv_id", F.array_join(F.transform("x", lambda r: r["role"]), ">").alias("roles"), "turns", "chars")


@query("query_sanitizer", f"SELECT conv_id, turn, length(trim(text)) >= 3 AND NOT regexp_matches(lower(text), {_rx('|'.join(X.PROHIBITED_TERMS))}) AS allowed FROM conversations")
def query_sanitizer(t):
    return t("conversations").select("conv_id", "turn", X.sanitize_query(F.col("text")).isNotNull().alias("allowed"))


_FACT = """{v} <> '' AND {v} NOT IN ({none}) AND trim({e}) <> '' AND (contains(lower({e}), {v}) OR (len({words}) > 0 AND len(list_filter({words}, lambda w: NOT contains(lower({e}), w))) = 0))"""
_WORDS = r"list_filter(string_split_regex(v, '[^\p{L}\p{N}\p{M}\p{Pc}]+'), lambda w: length(w) > 2)"


def _fact(evidence: str) -> str:
    return _FACT.format(v="v", e=evidence, words=_WORDS, none=_listed(R.NO_VALUE))


@query("fact_check", rf"""WITH b AS (SELECT item_id, text, unnest(string_split_regex(text, '[.\n]')) AS said FROM benchmark), s AS (SELECT b.item_id, lower(trim(said)) AS v, b.text AS own, o.text AS other FROM b LEFT JOIN benchmark o ON o.item_id = b.item_id - 1)
SELECT item_id, count(*) AS sentences, CAST(count(*) FILTER (WHERE {_fact("own")}) AS BIGINT) AS own, CAST(count(*) FILTER (WHERE {_fact("other")}) AS BIGINT) AS other FROM s GROUP BY item_id""")
def fact_check(t):
    """How many of each benchmark passage's sentences have evidence in the passage itself, and in the one before it."""
    b = t("benchmark").select("item_id", "text")
    other = b.select((F.col("item_id") + 1).alias("item_id"), F.col("text").alias("evidence"))
    s = b.join(other, "item_id", "left").select("*", F.explode(F.split("text", r"[.\n]")).alias("v"))
    has = lambda e: F.count_if(R.valid_fact(F.col("v"), F.col(e), F.lit("")))
    return s.groupBy("item_id").agg(F.count(F.lit(1)).alias("sentences"), has("text").alias("own"), has("evidence").alias("other"))


_TIERS = ["Enterprise Leaders (1,000+)", "Mid-Market Challengers (100-1,000)", "Growth SMBs (20-100)", "Early-Stage Startups (1-20)"]


@query("document_tiers", f"""WITH d AS (SELECT lower(coalesce(text, '')) AS t, ('0x' || substr(md5('https://' || source || '.example.com/' || doc_id), 1, 8))::BIGINT % 100 AS b FROM documents)
SELECT CASE WHEN regexp_matches(t, 'enterprise|global leader|fortune 500|multinational') THEN '{_TIERS[0]}' WHEN regexp_matches(t, 'mid-market|midmarket|established|challenger') THEN '{_TIERS[1]}'
  WHEN regexp_matches(t, 'growth|smb|series b|series a|scaling') THEN '{_TIERS[2]}' WHEN b < 60 THEN '{_TIERS[3]}' WHEN b < 85 THEN '{_TIERS[2]}' WHEN b < 95 THEN '{_TIERS[1]}' ELSE '{_TIERS[0]}' END AS tier, count(*) AS documents FROM d GROUP BY 1""")
def document_tiers(t):
    """Tier by words anywhere in the text, else by a stable hash of the address."""
    none = F.lit(None).cast("string")
    u = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/"), F.col("doc_id").cast("string"))
    return t("documents").groupBy(S.document_tier(none, none, F.col("text"), u).alias("tier")).agg(F.count(F.lit(1)).alias("documents"))


@query("document_facts")
def document_facts(t):
    """Head counts, years, technologies and profiles from prose; held against inline texts in the tests."""
    x = F.col("text")
    return t("documents").select("doc_id", E.size_from_prose(x)["tier"].alias("tier"), E.founded_year(x).alias("founded"), F.array_join(E.tech_stack(x), ",").alias("tech"), E.headquarters(x).alias("headquarters"), U.is_company_profile(x).alias("profile"))


_TOKENS = lambda c: rf"list_filter(string_split_regex(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


@query("phrase_sectors", f"""WITH b AS (SELECT item_id, {_TOKENS('text')} AS w FROM benchmark), p AS (SELECT DISTINCT 's' || (item_id % 8) AS sector, array_to_string(w[i:i + n - 1], ' ') AS phrase, n FROM b, range(1, 12) r(i), range(1, 4) s(n) WHERE i + n - 1 <= len(w) AND (n > 1 OR i % 4 = 0)),
d AS (SELECT doc_id, {_TOKENS('text')} AS w FROM documents), t AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), h AS (SELECT doc_id, sector FROM (SELECT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM t, range(1, 4) s(n) WHERE i + n - 1 <= len(w)) JOIN p USING (phrase, n)),
c AS (SELECT doc_id, sector, count(*) AS n FROM h GROUP BY ALL) SELECT doc_id, arg_min(sector, (-n, sector)) AS sector, max(n) AS score, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY doc_id""")
def phrase_sectors(t):
    """The sector of most phrases in each document, from a table of phrases of one to three words that the benchmark's passages give."""
    w = P.tokens(F.col("text"))
    b = t("benchmark").select("item_id", w.alias("w")).select("item_id", "w", F.explode(F.sequence(F.lit(1), F.lit(11))).alias("i")).select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n"))
    phrases = b.where("i + n - 1 <= size(w) and (n > 1 or i % 4 = 0)").select(F.concat(F.lit("s"), F.col("item_id") % 8).alias("sector"), F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("phrase"))
    c = P.phrase_hits(t("documents"), phrases, "doc_id", "text", "phrase").groupBy("doc_id", "sector").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("doc_id").agg(F.min_by("sector", F.struct(-F.col("n"), "sector")).alias("sector"), F.max("n").alias("score"), F.sum("n").alias("total"))
