"""Quality classifier from supervised subword embeddings.

A word's vector is the mean of learned vectors of its hash and of its hashed character n-grams; a document's is the mean of its words', its
word pairs' and one constant vector; a softmax over two classes gives the score. Vectors and output are learned together by numpy
stochastic gradient descent on a bounded sample of labelled rows, in one task. As everything up to the softmax is a mean, scoring needs one
number for each hash bucket (its vector times the difference of the output rows): 1 MB goes to the workers, the distinct words of a batch
are hashed together, and whole texts are scored with numpy.

Word pairs include the pair "same word again" and "same pair again" as hashed features, so loops are seen whatever they repeat.

Defined results: null and empty texts get the constant's score; a null doc_id is never labelled nor held out; null labels are ignored, of contrary
labels of one document the lower counts; without labels every score is 1; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlake.llm._common import body, cut, free, lean

BUCKET_BITS = 18
DIM = 16
NGRAMS = (3, 4, 5)
#: Labelled rows learned from, at most: the ones with the least hash of doc_id. Bounds the training task's time and memory.
TRAIN_ROWS = 4000
EPOCHS, RATE, SEED = 5, 0.5, 7
THRESHOLD = 0.7
HELD_OUT = "pmod(crc32(cast(doc_id as string)), 4) = 2"
CHUNK_BYTES = 1 << 20  # text scored at once
BLOCK_BYTES = 1 << 19  # text cut into n-grams at once, however long its words are
_PAIR, _MIX, _CONSTANT, _SAME, _AGAIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 1, 2, 3


def _hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * _MIX) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _features(words: list[bytes], h: np.ndarray):
    """(word, bucket) of every word itself and of its character n-grams: of bytes, with word borders. Rolling sums over all words, BLOCK_BYTES at a time."""
    yield np.arange(len(words)), _bucket(h)
    flat = np.frombuffer(b"".join([b"<" + w + b">" for w in words]), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)
    for a in range(0, len(flat), BLOCK_BYTES):
        z = min(a + BLOCK_BYTES, len(flat))
        text = flat[a : z + max(NGRAMS) - 1].astype(np.uint64)  # an n-gram belongs to the block that it starts in
        some = np.arange(np.searchsorted(ends, a, "right"), np.searchsorted(ends, z - 1, "right") + 1)
        word = np.repeat(some, np.diff(np.minimum(ends[some], z), prepend=a))
        left = ends[word] - np.arange(a, z)
        for n in NGRAMS:
            at = np.flatnonzero(left >= n)
            gram = np.full(len(at), n, np.uint64)
            for k in range(n):
                gram = gram * _PAIR + text[at + k]
            yield word[at], _bucket(gram ^ gram >> np.uint64(32))


def _pair_buckets(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bucket of each word with the word before it, -1 at the first words of texts. A word met again at once, or a pair that stands again
    two or three words on, has one bucket for all words."""
    out = np.empty(len(h), np.int64)
    out[:1] = -1
    out[1:] = ((h[:-1] * _PAIR + h[1:]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    out[1:][h[1:] == h[:-1]] = _SAME
    for lag in (2, 3, 4):
        if len(h) > lag:
            out[lag:][(h[lag:] == h[:-lag]) & (out[lag:] != _SAME) & (out[lag - 1 : -1] != -1)] = _AGAIN
    out[first] = -1
    return out


def _split(texts) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the index of each word in order, the number of words of each text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    ends = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(full)])
    counts = np.diff(upto[ends - ends[0]])
    coded = flat.dictionary_encode()
    return coded.dictionary.cast(pa.large_binary()).to_pylist(), coded.indices.to_numpy(zero_copy_only=False)[full], counts


@dataclass
class Model:
    table: np.ndarray  # one number for each bucket
    bias: float
    constant: bool = False  # nothing was learned: every score is 1

    def score(self, texts) -> np.ndarray:
        if self.constant:
            return np.ones(len(texts))
        words, idx, counts = _split(texts)
        each = _hashes(words)
        sums, parts = np.zeros(len(words)), np.zeros(len(words), np.int64)
        for word, bucket in _features(words, each):
            sums += np.bincount(word, self.table[bucket], len(words))
            parts += np.bincount(word, minlength=len(words))
        means = sums / np.maximum(parts, 1)
        ends = np.cumsum(counts)
        first = (ends - counts)[counts > 0]
        pairs = _pair_buckets(each[idx], first)
        both = means[idx] + np.where(pairs >= 0, self.table[pairs], 0.0)
        upto = np.concatenate([[0.0], np.cumsum(both)])
        total = upto[ends] - upto[ends - counts] + self.table[_CONSTANT]
        logit = total / (counts + np.maximum(counts - 1, 0) + 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def document_features(texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its buckets and their weights in the document's mean."""
    words, idx, counts = _split(texts)
    each = _hashes(words)
    word, bucket = map(np.concatenate, zip(*_features(words, each), strict=True))
    order = np.argsort(word, kind="stable")
    bucket = bucket[order]
    borders = np.searchsorted(word[order], np.arange(len(words) + 1))
    out, at = [], 0
    for n in counts.tolist():
        own = idx[at : at + n]
        at += n
        kinds, times = np.unique(own, return_counts=True)
        ids = [np.array([_CONSTANT]), *(bucket[borders[k] : borders[k + 1]] for k in kinds)]
        weights = [np.ones(1), *(np.full(borders[k + 1] - borders[k], t / (borders[k + 1] - borders[k])) for k, t in zip(kinds, times, strict=True))]
        if n > 1:
            pairs = _pair_buckets(each[own], np.array([0]))[1:]
            ids.append(pairs)
            weights.append(np.ones(len(pairs)))
        ids, weights = np.concatenate(ids), np.concatenate(weights)
        uniq, where = np.unique(ids, return_inverse=True)
        out.append((uniq.astype(np.int32), (np.bincount(where, weights) / (2 * n if n else 1)).astype(np.float32)))
    return out


def train(feats: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket vectors, output rows and output biases, by stochastic gradient descent over single documents, the rate falling to 0."""
    rng = np.random.default_rng(SEED)
    vec = ((rng.random((1 << BUCKET_BITS, DIM), np.float32) - 0.5) / DIM).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    steps, k = EPOCHS * len(feats), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(feats)):
            ids, w = feats[i]
            rate = np.float32(RATE * (1 - k / steps))
            k += 1
            own = vec[ids]
            doc = w @ own
            z = out @ doc + bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[labels[i]] -= 1
            back = out.T @ g
            out -= rate * np.outer(g, doc)
            bias -= rate * g
            vec[ids] = own - (rate * len(ids) ** 0.5) * np.outer(w, back)
    return vec, out, bias


def _trainer(pdf):
    import pandas as pd
    import pyarrow as pa

    pdf = pdf.sort_values("doc_id", kind="stable")
    labels = pdf["quality"].to_numpy(np.int64)
    feats = []
    for i in range(0, len(pdf), 200):
        feats += document_features(pa.array(pdf["text"].iloc[i : i + 200].tolist(), pa.large_string()))
    vec, out, bias = train(feats, labels)
    diff = out[1] - out[0]
    return pd.DataFrame({"table": [(vec @ diff).astype("<f4").tobytes()], "bias": [float(bias[1] - bias[0])], "vectors": [vec.astype("<f4").tobytes()], "output": [out.astype("<f4").tobytes()], "rows": [len(pdf)]})


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learns from labelled documents that are not held out. The model (vectors too) is written as a table of one row in the shared folder."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    y = y.where(f"not ({HELD_OUT})").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    y = cut(y.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows), "subword-labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    rows = texts.join(F.broadcast(y), "doc_id").groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("text").alias("text"))  # y has at most train_rows rows
    made = cut(rows.groupBy().applyInPandas(_trainer, "table binary, bias double, vectors binary, output binary, rows long"), "subword-model")
    got = made.where("rows > 0").select("table", "bias").first()
    if got is None:
        return Model(np.zeros(1, np.float32), 0.0, True)
    return Model(np.frombuffer(bytes(got["table"]), "<f4").astype(np.float64), got["bias"])


def _scorer(model: Model, name: str):
    def run(batches):
        import pyarrow as pa

        from leadlake.llm.tokens import chunks

        lean()
        for b in batches:
            scores = [model.score(c) for _, c in chunks(b.column("text"), CHUNK_BYTES)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*b.schema.names, name])

    return run


def scored(docs: DataFrame, model: Model, name: str = "_score") -> DataFrame:
    """docs with its score as a further column. docs has text as a string column and none of that name."""
    return docs.mapInArrow(_scorer(model, name), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    return scored(rows, model).select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def survivors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier predicts good, with all their columns."""
    name = free(docs, "score")
    return scored(docs, fit(docs, labels), name).where(F.col(name) >= THRESHOLD).drop(name)
