"""Token ids of whole texts, by the tokenizers library, for Arrow batches.

The public tokenizer drops white space and never joins what stands on both sides of it, so a text's ids are the ids of its words in
order. Each batch is split into words, each distinct word is encoded once, and the ids are gathered with numpy. Words made of letters and
printable ASCII take the model directly, after the tokenizer's own normalisation and split; every other word takes the whole tokenizer.
A cache of bounded size carries frequent words from batch to batch. The tests hold the result against plain whole-text encoding.

Defined results: null text is empty; an empty text is END_ID alone; a tokenizer whose ids don't fit 16 bits, or that joins words across white
space, is refused when it is loaded; a text longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 2
#: Bounds, not results, depend on these: distinct words kept for each worker, and bytes of text handled at once.
CACHE_WORDS = 500_000
CACHE_PIECES = 50_000
CHUNK_BYTES = 6 << 20

#: The tokenizer's split pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: A tokenizer is taken only if it encodes these as the words they are made of.
PROBES = ["Hello, big world! it's 12 o'clock; naïve café", "  two  spaces\tand\nlines ", "日本語 テスト 😀 ½ Ⅷ ΣΑΣ", "a-b_c/d (e) [f] {g} #1 $2 100% x@y.z", "camelCase UPPER don't we'll they're"]

_ENCODERS: dict[str, WordEncoder] = {}


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for the code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class WordEncoder:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.most = CACHE_WORDS
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.split = regex.compile(SPLIT).findall
        self.safe = regex.compile(r"[\x21-\x7E\p{L}]+").fullmatch
        self.letters = _byte_letters()
        self.marks = frozenset(".,;:!?")
        self.words: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError(f"{path}: ids must fit 16 bits")
        for t in PROBES:
            if array("H", self.whole.encode(t, add_special_tokens=False).ids).tobytes() != b"".join(map(self.word, t.split())):
                raise ValueError(f"{path}: the tokenizer's ids are not those of single words")

    def _letters_only(self, low: str) -> bytes:
        """Ids of one lower-case piece."""
        mapped = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
        return array("H", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _piece(self, p: str) -> bytes:
        if (out := self.pieces.get(p)) is None:
            out = self._letters_only(p)
            if len(self.pieces) < CACHE_PIECES:
                self.pieces[p] = out
        return out

    def _plain(self, w: str) -> str | None:
        """w in lower case if it is letters only, as the tokenizer would normalise it; else None."""
        if not w.isalpha():
            return None
        low = w.lower()
        return low if w.isascii() or (low.isalpha() and "\u03a3" not in w and unicodedata.is_normalized("NFC", w)) else None

    def word(self, w: str) -> bytes:
        """Ids of a text without ASCII white space, as little-endian 16-bit integers."""
        if (low := self._plain(w)) is not None:
            return self._letters_only(low)
        if w[-1:] in self.marks and (low := self._plain(w[:-1])) is not None:
            return self._letters_only(low) + self._piece(w[-1])
        low = w.lower()
        if self.safe(w) and self.safe(low) and "<|" not in w and "\u03a3" not in w and (w.isascii() or (unicodedata.is_normalized("NFC", w) and all(c < "\x80" or c.isalpha() for c in w))):
            return b"".join(map(self._piece, self.split(low)))
        return array("H", self.whole.encode(w, add_special_tokens=False).ids).tobytes()

    def distinct(self, words: list[str]) -> list[bytes]:
        get, room, out = self.words.get, self.most - len(self.words), []
        for w in words:
            x = get(w)
            if x is None:
                x = self.word(w)
                if room > 0:
                    self.words[w] = x
                    room -= 1
            out.append(x)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids (uint16) of all texts one after another, each with END_ID at its end, and where each begins (one more entry at the end)."""
        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        ends = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        found = self.distinct(words.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(found), np.uint16)
        lens = np.fromiter(map(len, found), np.int64, len(found)) // 2
        firsts = np.cumsum(lens) - lens
        idx = words.indices.to_numpy(zero_copy_only=False)
        n = lens[idx]
        upto = np.concatenate([[0], np.cumsum(n)])
        per_text = upto[ends - ends[0]]
        starts = per_text + np.arange(len(per_text))
        out = np.empty(int(starts[-1]), np.uint16)
        take = np.repeat(firsts[idx] - upto[:-1], n) + np.arange(int(upto[-1]))
        is_end = np.zeros(len(out), bool)
        is_end[starts[1:] - 1] = True
        out[is_end] = END_ID
        out[~is_end] = flat[take]
        return out, starts


def forget() -> None:
    """Drops the encoders of this process with their caches."""
    _ENCODERS.clear()


def encoder(path: str, most: int | None = None) -> WordEncoder:
    """This process's encoder, which keeps at most so many words (CACHE_WORDS)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    enc = _ENCODERS[path]
    enc.most = CACHE_WORDS if most is None else most
    if len(enc.words) > enc.most:
        enc.words = {"": b""}
    return enc


def chunks(texts: pa.Array, most: int | None = None):
    """Slices of at most so many bytes of text (CHUNK_BYTES), or of one text."""
    texts = texts.cast(pa.large_string()).fill_null("") if texts.null_count else texts.cast(pa.large_string())
    at = texts.offsets.to_numpy(zero_copy_only=False) if hasattr(texts, "offsets") else None
    if at is None:
        at = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
    n, i = len(texts), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + (most or CHUNK_BYTES), "right")) - 1)
        yield i, texts.slice(i, j - i)
        i = j


def crc(ids: np.ndarray) -> int:
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
