"""Token ids of whole texts by a public BPE file of the ``tokenizers`` library.

BPE works on each pre-token alone, so a worker encodes every distinct pre-token
once and looks the others up. The split is done on code points with numpy for
texts of Latin characters; any other text is encoded whole by the library.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from roadtrace.llm.kernels import chunks, ragged, span_hashes

END_ID = 1
#: Distinct pre-tokens a worker remembers (about 40 bytes each); beyond it the memory starts anew.
CACHE_WORDS = 600_000
_LATIN = 0x250
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _latin_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, lower case and safety of each code point below 0x250 (all of them are unchanged by NFC)."""
    kind, lower, safe = np.zeros(_LATIN, np.uint8), np.zeros(_LATIN, np.uint32), np.ones(_LATIN, bool)
    for c in range(_LATIN):
        low = chr(c).lower()
        safe[c] = len(low) == 1
        lower[c] = ord(low[0])
        major = unicodedata.category(chr(c))[0]
        if chr(c).isspace() and not 0x1C <= c <= 0x1F:
            kind[c] = _SPACE
        else:
            kind[c] = {"L": _LETTER, "N": _NUMBER}.get(major, _OTHER)
    safe[0x1C:0x20] = False
    return kind, lower, safe


class WordCachedTokenizer:
    """Encodes batches of texts to ids (``dtype`` holds all of them); equal to the library's ids for whole texts without special tokens."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind, self.lower, self.safe = _latin_tables()
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        for piece, i in vocab.items():
            self.ends_word[i] = piece.endswith("</w>")
        self.dtype = np.uint16 if len(self.ends_word) <= 1 << 16 and END_ID < 1 << 16 else np.uint32
        self.cache_words = cache_words
        self._reset()

    def _reset(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def encode(self, texts: list) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        for a, b in chunks(texts):
            self._encode_chunk(texts[a:b], out, a)
        return out

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def _encode_chunk(self, texts: list, out: list, base: int) -> None:
        fast = []
        for i, t in enumerate(texts):
            if not t:
                continue
            if "<|" in t:  # special tokens are matched in raw text
                out[base + i] = self._whole(t)
                continue
            fast.append(i)
        if not fast:
            return
        joined = "\n".join(texts[i] for i in fast) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(texts[i]) + 1 for i in fast])
        stops = np.cumsum(lengths)
        odd = codes >= _LATIN
        narrow = np.where(odd, 0x1C, codes)
        bad = ~self.safe[narrow]
        if bad.any():
            wide = np.unique(np.searchsorted(stops, np.flatnonzero(bad), side="right"))
            for j in wide:
                out[base + fast[j]] = self._whole(texts[fast[j]])
            keep = np.ones(len(fast), bool)
            keep[wide] = False
            narrow = narrow[np.repeat(keep, lengths)]
            fast = [i for i, k in zip(fast, keep, strict=True) if k]
            lengths = lengths[keep]
            stops = np.cumsum(lengths)
            if not fast:
                return
        lower = self.lower[narrow]
        starts, ends = self._split(lower, self.kind[narrow])
        ids, n = self._lookup(lower, starts, ends)
        word_stops = np.searchsorted(starts, stops)
        cut = np.concatenate([[0], np.cumsum(n)])[word_stops]
        for i, part in zip(fast, np.split(ids, cut[:-1]), strict=True):
            out[base + i] = part

    def _split(self, lower: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans of letters, single numbers, runs of other characters and the seven English contractions."""
        before = np.concatenate([[_SPACE], kind[:-1]])
        start = (kind != _SPACE) & ((kind != before) | (kind == _NUMBER))
        quote = np.flatnonzero(start & (lower == 39))
        quote = quote[quote + 2 < len(lower)]
        if len(quote):
            a, b = lower[quote + 1], lower[quote + 2]
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            for hit, n in ((one, 2), (two, 3)):
                q = quote[hit]
                start[q + 1] = False
                q = q[q + n < len(lower)]
                start[q + n] |= kind[q + n] == _LETTER
        starts = np.flatnonzero(start)
        nxt = np.concatenate([starts[1:], [len(lower)]])
        # a span ends at the next span or at the first white space after its start
        space = np.flatnonzero(kind == _SPACE)
        first_space = space[np.searchsorted(space, starts)] if len(space) else np.full(len(starts), len(lower))
        return starts, np.minimum(nxt, first_space)

    def _lookup(self, lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = span_hashes(lower, starts, ends)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > self.cache_words:
            self._reset()
        spot = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = spot < len(self.keys)
        known[inside] = self.keys[spot[inside]] == unique[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = lower.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            words = [raw[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            self._learn(unique[new], words)
            spot = np.searchsorted(self.keys, unique)
        at, n = self.at[spot][inverse], self.n[spot][inverse]
        return self.flat[ragged(at, n)], n

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Encode words that are new here. They are joined by blanks, and the ids that end a word part them again."""
        encoded = self.tokenizer.encode_batch_fast([" ".join(words[i : i + 500]) for i in range(0, len(words), 500)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.int32) for e in encoded])
        stops = np.flatnonzero(self.ends_word[ids]) + 1
        if len(stops) != len(words):  # a word that is several pre-tokens by itself
            parts = [self._whole(w) for w in words]
            ids, stops = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        at = np.concatenate([[0], stops[:-1]])
        self.keys = np.concatenate([self.keys, keys])
        self.at = np.concatenate([self.at, at + len(self.flat)])
        self.n = np.concatenate([self.n, stops - at])
        self.flat = np.concatenate([self.flat, ids])
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.at, self.n = self.keys[order], self.at[order], self.n[order]


_held: dict[str, WordCachedTokenizer] = {}


def worker_tokenizer(path: str) -> WordCachedTokenizer:
    """One tokenizer for each Python worker."""
    if path not in _held:
        _held[path] = WordCachedTokenizer(path)
    return _held[path]


def digest(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
