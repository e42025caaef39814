"""op3 reads words of any length whole."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from leadlake.llm import subword

LONG = "日本語の文章には空白がありません。" * 40


def slow_buckets(word):
    framed, m = b"<" + word + b">", 2**64 - 1
    for n in subword.NGRAMS:
        for i in range(len(framed) - n + 1):
            g = n
            for c in framed[i : i + n]:
                g = (g * int(subword._PAIR) + c) & m
            yield ((g ^ g >> 32) * int(subword._MIX) & m) >> 64 - subword.BUCKET_BITS


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_ngrams_of_whole_words_in_blocks(monkeypatch, block):
    monkeypatch.setattr(subword, "BLOCK_BYTES", block)
    words = [b"a", b"word", LONG.encode(), "é".encode() * 50, b"x" * 200]
    h = subword._hashes(words)
    got = Counter((int(w), int(b)) for ws, bs in subword._features(words, h) for w, b in zip(ws, bs, strict=True))
    assert got == Counter((i, int(b)) for i, w in enumerate(words) for b in [subword._bucket(h[i : i + 1])[0], *slow_buckets(w)])


def test_a_change_late_in_a_long_word_changes_its_score_by_its_ngrams():
    a, b = "x" * 100 + "abcdefgh", "x" * 100 + "hgfedcba"
    fa, fb = (set(ids.tolist()) for ids, _ in subword.document_features(pa.array([a, b], pa.large_string())))
    assert len(fa - fb) > 10 and len(fb - fa) > 10
    table = np.zeros(1 << subword.BUCKET_BITS)
    table[list(slow_buckets(b"fgh"))] = 1.0
    plain, late = subword.Model(table, 0.0).score(pa.array(["y" * 108, "y" * 105 + "fgh"], pa.large_string()))
    assert plain == 0.5 < late
