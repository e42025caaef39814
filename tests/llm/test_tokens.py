"""op1 and op6: token ids against whole-text encoding, exact round trips."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leadlake.llm import packing, tokens, wavelet

PATH = tokens.default_path()
WHOLE = Tokenizer.from_file(PATH)


def plain(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_batches_encode_as_whole_texts(texts):
    enc, got = tokens.encoder(PATH), []
    for _, c in tokens.chunks(pa.array(texts, pa.string())):
        ids, starts = enc.encode(c)
        got += [ids[a:z].tolist() for a, z in zip(starts[:-1], starts[1:], strict=True)]
    assert got == [plain(t) for t in texts]


def test_code_points_that_only_some_tables_call_letters():
    texts = [":\U0003d000", "a\U0003d000b", "\U000323b0:", "é:\U0002ebf0", "x.\U00030000"]
    ids, starts = tokens.encoder(PATH).encode(pa.array(texts))
    assert [ids[a:z].tolist() for a, z in zip(starts[:-1], starts[1:], strict=True)] == [plain(t) for t in texts]


def test_cache_and_chunk_bounds_do_not_change_results(monkeypatch, odd_rows):
    texts = [r[1] or "" for r in odd_rows]
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    monkeypatch.setattr(tokens, "CHUNK_BYTES", 500)
    enc, got = tokens.WordEncoder(PATH), []
    for _, c in tokens.chunks(pa.array(texts)):
        ids, starts = enc.encode(c)
        got += [ids[a:z].tolist() for a, z in zip(starts[:-1], starts[1:], strict=True)]
    assert got == [plain(t) for t in texts]
    assert len(enc.words) <= 4


def test_op1_reads_back_every_document(odd, odd_rows):
    got = wavelet.op1(odd).collect()
    want = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in odd_rows))
    start, expected = 0, []
    for has, i, t in want:
        ids = plain(t)
        expected.append((i if has else None, start, len(ids), crc(ids)))
        start += len(ids)
    key = lambda r: r[1]
    assert sorted((tuple(r)[:4] for r in got), key=key) == expected


def test_op1_cuts_shards(odd, tmp_path, spark):
    folder = f"file://{tmp_path}/shards"
    manifest = wavelet.write_shards(odd, folder, shard_tokens=500)
    assert manifest.count() > 5
    rows = wavelet.read_shards(spark, folder, manifest).orderBy("start").collect()
    assert len(rows) == odd.count()
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))


def test_op1_empty(none):
    assert wavelet.op1(none).collect() == []


@pytest.mark.parametrize("n", [0, 1, 7, 8, 70_000, 200_003])
def test_wavelet_matrix_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 49_408).astype(np.uint16)
    cuts = np.concatenate([[0], np.sort(rng.integers(0, n + 1, 3)), [n]])
    doc_ids, borders, m = wavelet.unpack(wavelet.pack(np.arange(4), cuts, ids))
    assert borders.tolist() == cuts.tolist() and doc_ids.tolist() == [0, 1, 2, 3]
    assert (m.decode() == ids).all()
    r = random.Random(1)
    for _ in range(20 if n else 0):
        i = r.randrange(n)
        t = int(ids[i])
        assert m.access(i) == t
        assert m.rank(t, i) == int((ids[:i] == t).sum())
        assert m.rank(t) == int((ids == t).sum())
        assert m.select(t, m.rank(t, i)) == i
    assert m.rank(65_535) == 0
    if n:
        rare = int(ids[np.argmin(np.bincount(ids)[ids])])
        assert m.occurrences(rare) == np.flatnonzero(ids == rare).tolist()


def test_cuts_keep_length_and_classes():
    for n in [*range(0, 5000), 8192, 12289, 100_001]:
        pieces = packing.cuts(n)
        assert sum(p for p, _ in pieces) == n
        assert all(1 <= p and p * i <= 4096 for p, i in pieces)


def check_packing(rows, texts):
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id, r.doc_tokens].append(r)
        seqs[r.sequence_id].append(r)
    for ps in seqs.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
    return docs, seqs


def test_op6_pieces_tile_documents_and_sequences(odd, odd_rows):
    rows = packing.op6(odd).collect()
    docs, seqs = check_packing(rows, odd_rows)
    assert sorted(seqs) == list(range(len(seqs)))
    total = sum(r.length for r in rows)
    assert total == sum(len(plain(r[1])) for r in odd_rows)
    assert len(seqs) <= total / 4096 * 1.05 + 2
    once = {r[0]: plain(r[1]) for r in odd_rows if r[0] not in (None, 30)}
    for i, ids in once.items():
        at = 0
        for p in sorted(docs[i, len(ids)], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)


def test_packing_tasks_are_bounded_in_memory(monkeypatch):
    """Many different words in one batch: the task encodes a megabyte at once, keeps a bounded number of words, and its pieces are those of the whole texts."""
    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: type("Context", (), {"partitionId": lambda self: 0})()))
    monkeypatch.setattr(tokens, "_ENCODERS", {})
    at_once, plainly = [], tokens.WordEncoder.encode
    monkeypatch.setattr(tokens.WordEncoder, "encode", lambda self, c: at_once.append(c.nbytes) or plainly(self, c))
    rng = random.Random(3)
    texts = [" ".join("%x" % rng.getrandbits(40) for _ in range(1500)) for _ in range(170)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    out = [r for b in packing._cutter(PATH, 4096)(iter([batch])) for r in b.to_pylist()]
    assert batch.nbytes > 2.5e6 and len(at_once) >= 3 and max(at_once) < 1.1e6
    assert 100_000 < len(tokens._ENCODERS[PATH].words) <= 200_000
    for d in (0, 77, 169):
        ids = plain(texts[d])
        mine = [r for r in out if r["doc_id"] == d]
        assert sum(r["length"] for r in mine) == len(ids) and all(r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]]) for r in mine)
    assert len(tokens.encoder(PATH).words) > 100_000 >= len(tokens.encoder(PATH, 100_000).words)


def test_op6_empty(none):
    assert packing.op6(none).collect() == []
