"""Vectorised text helpers that run inside Spark tasks: word spans, 64-bit hashes, ragged gathers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters handled at once; bounds the scratch arrays to a few tens of MB.
CHUNK_CHARS = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: np.ndarray = np.ones(1, np.uint64)
_inverse: np.ndarray = np.ones(1, np.uint64)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finalise 64-bit hashes (a bijection for each salt)."""
    h = h + np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) >= n:
        return
    n = 1 << (n - 1).bit_length()
    inv = np.uint64(pow(int(_BASE), -1, 2**64))
    for name, base in (("_powers", _BASE), ("_inverse", inv)):
        a = np.full(n, base, np.uint64)
        a[0] = 1
        globals()[name] = np.multiply.accumulate(a)


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of codes[start:end] for each span, equal for equal content anywhere."""
    _grow(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers[: len(codes)], out=total[1:])
    return mix((total[ends] - total[starts]) * _inverse[starts] + (ends - starts).astype(np.uint64))


def chunks(texts: list, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters in all; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Words:
    """Words of several texts: maximal runs of ASCII letters (lower-cased), digits and non-ASCII characters.

    ``hashes`` has one value per word, ``bounds[i]:bounds[i + 1]`` are the words of text i, ``lengths`` their UTF-8 bytes.
    """

    def __init__(self, texts: list):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = b"\n".join(raw).translate(_LOWER)
        a = np.frombuffer(data, np.uint8)
        inside = np.zeros(len(a) + 2, np.int8)
        inside[1:-1] = _WORD[a]
        edge = np.diff(inside)
        self.data, self.starts, self.ends = data, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(r) + 1 for r in raw], out=offsets[1:])
        self.bounds = np.searchsorted(self.starts, offsets)
        self.hashes = span_hashes(a, self.starts, self.ends)
        self.lengths = self.ends - self.starts


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of k consecutive word hashes, one for each start (length n - k + 1)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _BASE + hashes[i : i + n]
    return mix(out, k)


def doc_shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All k-word shingles of each text and their bounds; a text of fewer words, but not none, has one of all its words."""
    counts = np.diff(words.bounds)
    every = shingle_hashes(words.hashes, k)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(n)])
    at = ragged(words.bounds[:-1], n)
    out = np.zeros(bounds[-1], np.uint64)
    full = np.repeat(counts >= k, n)
    out[full] = every[at[full]]
    for i in np.flatnonzero((counts > 0) & (counts < k)):
        own = words.hashes[words.bounds[i] : words.bounds[i + 1]]
        out[bounds[i]] = mix(shingle_hashes(own, len(own)), 77)[0]
    return out, bounds


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start + 1, ... of the given counts."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts - starts, counts)


def iter_groups(frames, key: str):
    """Frames of whole groups from batches sorted by ``key``: the last group of a batch waits for the next one."""
    import pandas as pd

    held = []
    for frame in frames:
        if not len(frame):
            continue
        keys = frame[key].to_numpy()
        other = np.flatnonzero(keys != keys[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if held and held[-1][key].iloc[-1] != keys[0]:
            yield pd.concat(held, ignore_index=True)
            held = []
        if cut:
            yield pd.concat([*held, frame.iloc[:cut]], ignore_index=True)
            held = []
        held.append(frame.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)
