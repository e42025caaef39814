"""Token ids as wavelet matrices, one compressed file for each shard of documents in ascending doc_id order.

A wavelet matrix keeps one bit-plane for each bit of the ids, most significant first; between planes the zeros move stably to the front.
With counts of ones at block borders each plane answers rank in constant time, so one file gives the token at a position, the number of
occurrences of an id before a position, and the position of its k-th occurrence, without the ids being unpacked.

File: the magic bytes, a little-endian header (bits, block bytes, documents, tokens), the zeros of each plane, the documents' ids and
borders, then for each plane the ones before each block and the blocks, each packed by zstd on its own with its place in a directory.
Reading touches only the blocks that an answer needs.

Defined results: null text is empty (its document is the end id alone); a null doc_id sorts first; rows with equal doc_id are ordered by text;
an empty table gives no files and an empty result; other columns are left alone.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from leadlake.llm._common import body, cut, parts, scratch
from leadlake.llm.tokens import chunks, crc, default_path, encoder

MAGIC = b"WVLTMTX1"
NO_ID = -(1 << 63)
#: A shard closes when it holds this many tokens; a longer document makes a longer shard.
SHARD_TOKENS = 2_000_000
BLOCK = 1 << 13  # bytes of a plane in one packed block


class WaveletMatrix:
    """Rank, select and access over planes of bits. Planes come from build() or from a file, block by block."""

    def __init__(self, n: int, zeros: list[int], block, ones_before: list[np.ndarray], size: int = BLOCK):
        self.n, self.zeros, self.block, self.ones_before, self.size = n, zeros, block, ones_before, size
        self.bits = len(zeros)

    @staticmethod
    def planes(ids: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[int]]:
        """Each plane's packed bits and number of zeros."""
        seq, out, zeros = ids, [], []
        for level in range(bits):
            on = (seq & ids.dtype.type(1 << (bits - 1 - level))) != 0
            out.append(np.packbits(on, bitorder="little"))
            zero = seq[~on]
            zeros.append(len(zero))
            seq = np.concatenate([zero, seq[on]])
        return out, zeros

    @classmethod
    def build(cls, ids: np.ndarray, bits: int | None = None) -> WaveletMatrix:
        bits = bits or max(1, int(ids.max(initial=1)).bit_length())
        planes, zeros = cls.planes(ids, bits)
        return cls(len(ids), zeros, lambda lv, b: planes[lv][b * BLOCK : (b + 1) * BLOCK], [_ones_before(p) for p in planes])

    def _plane(self, level: int) -> np.ndarray:
        k = -(-((self.n + 7) // 8) // self.size)
        return np.concatenate([self.block(level, b) for b in range(k)]) if k else np.zeros(0, np.uint8)

    def decode(self) -> np.ndarray:
        """All ids in order: the planes are undone from the least significant up."""
        vals = np.zeros(self.n, np.uint32 if self.bits > 16 else np.uint16)
        for level in reversed(range(self.bits)):
            on = np.unpackbits(self._plane(level), count=self.n, bitorder="little").view(bool)
            z, out = self.zeros[level], np.empty_like(vals)
            out[~on] = vals[:z]
            out[on] = vals[z:] | vals.dtype.type(1 << (self.bits - 1 - level))
            vals = out
        return vals

    def _rank1(self, level: int, i: int) -> int:
        byte, bit = divmod(i, 8)
        b, off = divmod(byte, self.size)
        if b >= len(self.ones_before[level]) - 1 and off == 0 and bit == 0:
            return int(self.ones_before[level][b])
        blk = self.block(level, b)
        ones = int(self.ones_before[level][b]) + int(np.bitwise_count(blk[:off]).sum())
        return ones + (int(blk[off]) & ((1 << bit) - 1)).bit_count() if bit else ones

    def _bit(self, level: int, i: int) -> int:
        b, off = divmod(i // 8, self.size)
        return int(self.block(level, b)[off]) >> (i % 8) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level, z in enumerate(self.zeros):
            bit = self._bit(level, i)
            r = self._rank1(level, i)
            i = z + r if bit else i - r
            out = out << 1 | bit
        return out

    def _narrow(self, token: int, i: int) -> tuple[int, int]:
        """In the last plane's order, the token's first place and the end of those that stand before i."""
        lo, hi = 0, i
        for level, z in enumerate(self.zeros):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (z + a, z + b) if token >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int | None = None) -> int:
        """Occurrences of token before position i (of all if None)."""
        if token >> self.bits:
            return 0
        lo, hi = self._narrow(token, self.n if i is None else i)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Position of occurrence k (from 0) of token."""
        if not 0 <= k < self.rank(token):
            raise IndexError(k)
        at = self._narrow(token, self.n)[0] + k
        for level in reversed(range(self.bits)):
            one = token >> (self.bits - 1 - level) & 1
            want = at - self.zeros[level] if one else at
            lo, hi = 0, self.n
            while hi - lo > 1:  # the place that holds the bit number want of this kind
                mid = (lo + hi) // 2
                r = self._rank1(level, mid)
                if (r if one else mid - r) <= want:
                    lo = mid
                else:
                    hi = mid
            at = lo
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.rank(token))]


def _ones_before(plane: np.ndarray) -> np.ndarray:
    sums = [int(np.bitwise_count(plane[i : i + BLOCK]).sum()) for i in range(0, len(plane), BLOCK)]
    return np.concatenate([[0], np.cumsum(sums)]).astype("<u4") if sums else np.zeros(1, "<u4")


def pack(doc_ids: np.ndarray, borders: np.ndarray, ids: np.ndarray, bits: int = 16) -> bytes:
    """The bytes of one shard file. borders: where each document begins in ids, and their end."""
    import zstandard

    planes, zeros = WaveletMatrix.planes(ids, bits)
    press = zstandard.ZstdCompressor(level=1).compress
    out = [MAGIC, struct.pack("<IIQQ", bits, BLOCK, len(doc_ids), len(ids)), np.asarray(zeros, "<u8").tobytes(), doc_ids.astype("<i8").tobytes(), borders.astype("<u8").tobytes()]
    for p in planes:
        blocks = [press(p[i : i + BLOCK].tobytes()) for i in range(0, len(p), BLOCK)]
        out += [_ones_before(p).tobytes(), np.cumsum([0, *map(len, blocks)]).astype("<u4").tobytes(), *blocks]
    return b"".join(out)


def unpack(data) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """doc_ids, borders and the matrix of a shard file; blocks are unpacked as they are asked for."""
    import functools

    import zstandard

    if bytes(data[: len(MAGIC)]) != MAGIC:
        raise ValueError("not a shard of token ids")
    at = len(MAGIC)
    bits, block, docs, n = struct.unpack_from("<IIQQ", data, at)
    at += 24

    def take(kind: str, k: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, k, at)
        at += out.nbytes
        return out

    zeros, doc_ids, borders = [int(x) for x in take("<u8", bits)], take("<i8", docs), take("<u8", docs + 1).astype(np.int64)
    k = -(-((n + 7) // 8) // block)
    ones, places = [], []
    for _ in range(bits):
        ones.append(take("<u4", k + 1))
        d = take("<u4", k + 1).astype(np.int64)
        places.append(at + d)
        at += int(d[-1])
    open_ = zstandard.ZstdDecompressor().decompress

    @functools.lru_cache(256)
    def get(level: int, b: int) -> np.ndarray:
        p = places[level]
        return np.frombuffer(open_(bytes(data[p[b] : p[b + 1]])), np.uint8)

    return doc_ids, borders, WaveletMatrix(n, zeros, get, ones, block)


def _writer(folder: str, tokenizer: str, shard_tokens: int):
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        part, seq = TaskContext.get().partitionId(), 0
        attempt = TaskContext.get().taskAttemptId()
        enc = encoder(tokenizer)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        total = 0

        def flush():
            nonlocal held, total, seq
            ids, doc_ids = np.concatenate([h[1] for h in held]), np.concatenate([h[0] for h in held])
            lens = np.concatenate([h[2] for h in held])
            data = pack(doc_ids, np.concatenate([[0], np.cumsum(lens)]), ids)
            name = f"{root}/{part:06d}-{seq:06d}.wm"
            with store.open_output_stream(f"{root}/_{part}-{seq}-{attempt}") as f:
                f.write(data)
            store.move(f"{root}/_{part}-{seq}-{attempt}", name)  # whole or not at all; a repeated task writes the same bytes
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "docs": [len(doc_ids)], "tokens": [len(ids)]}, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64())]))
            held, total, seq = [], 0, seq + 1
            return row

        store.create_dir(root, recursive=True)
        for b in batches:
            docs = b.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for i, c in chunks(b.column("text")):
                ids, starts = enc.encode(c)
                lens, i0 = np.diff(starts), 0
                while i0 < len(lens):  # cut where a shard is full
                    room = int(np.searchsorted(starts, starts[i0] + shard_tokens - total, "left"))
                    j = min(len(lens), max(i0 + 1, room))
                    held.append((docs[i + i0 : i + j], ids[starts[i0] : starts[j]], lens[i0:j]))
                    total += int(starts[j] - starts[i0])
                    i0 = j
                    if total >= shard_tokens:
                        yield flush()
        if held:
            yield flush()

    return run


def _reader(batches):
    import pyarrow as pa

    for b in batches:
        for path, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
            part, seq = map(int, path.rpartition("/")[2].removesuffix(".wm").split("-"))
            doc_ids, borders, m = unpack(data.as_buffer())
            ids = m.decode()
            n = len(doc_ids)
            crcs = np.fromiter((crc(ids[a:z]) for a, z in zip(borders[:-1], borders[1:], strict=True)), np.int64, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seq, np.int32)), pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(borders[:-1]), pa.array(np.diff(borders)), pa.array(crcs)],
                names=["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"],
            )


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the shard files of docs to folder; returns the manifest: part, seq, docs, tokens (file part-seq.wm, in this order)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    dealt = rows.repartitionByRange(parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("docs", T.LongType()), T.StructField("tokens", T.LongType())])
    return cut(dealt.mapInArrow(_writer(folder, tokenizer or default_path(), shard_tokens), schema), "wavelet-manifest")


def read_shards(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and the shard of each document, from the files."""
    schema = "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long"
    if manifest.isEmpty():
        rows = spark.createDataFrame([], schema)
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder).select("path", "content")
        rows = files.mapInArrow(_reader, schema)
    per_part = manifest.groupBy("part").agg(F.sum("tokens").alias("t"))
    per_part = per_part.select("part", F.coalesce(F.sum("t").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(manifest.join(per_part, "part").select("part", "seq", (F.col("base") + inner).alias("base")), "wavelet-offsets")
    out = rows.join(offsets, ["part", "seq"])
    return out.select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", F.format_string("%06d-%06d", "part", "seq").alias("shard"))


def op1(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    folder = scratch(spark, "wavelet")
    return read_shards(spark, folder, write_shards(docs, folder))
