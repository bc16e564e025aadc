"""Word shingles of whole texts in numpy: 64-bit hashed sets, one-permutation signatures, exact overlap."""

from __future__ import annotations

import hashlib

import numpy as np

_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = _RNG.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 16)
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64))]) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lowered, cut at ASCII white space), and the texts' offsets into them."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    data = _LOWER[np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)]
    solid = ~_SPACE[data]
    edge = np.diff(solid.view(np.int8))
    start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    up, down = _power_tables(len(data) + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)])])
    words = mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))
    text_start = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return words, np.searchsorted(start, text_start)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text; fewer words are one shingle, none is the empty set."""
    words, at = word_hashes(texts)
    total = np.full(max(0, len(words) - k + 1), k, np.uint64)
    for j in range(k):
        total += words[j : j + len(total)] * _STEP[j]
    total = mix(total)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        n = b - a
        if n >= k:
            s = np.sort(total[a : b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            out.append(mix(np.array([n], np.uint64) + (words[a:b] * _STEP[:n]).sum(dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = overlap(a, b)
    return 100 * common >= percent * (len(a) + len(b) - common) and common > 0


class OnePermutation:
    """One-permutation MinHash with ``bins`` bins, filled up by optimal densification.

    The hash range is cut into bins, a set's least hash in each is kept. An empty bin takes the value of a
    filled one, found by a random probe order that belongs to the bin alone, so any two sets probe alike.
    """

    def __init__(self, bands: int, rows: int, seed: int = 7):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        rng = np.random.default_rng(seed)
        self.probe = np.array([rng.permutation(self.bins) for _ in range(self.bins)])
        self.weight = rng.integers(0, 2**64, self.bins, dtype=np.uint64).reshape(bands, rows) | np.uint64(1)
        self.band_salt = rng.integers(0, 2**64, bands, dtype=np.uint64)

    def signature(self, s: np.ndarray) -> np.ndarray:
        bin_ = ((s >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], bin_[1:] != bin_[:-1]]))
        out, filled = np.zeros(self.bins, np.uint64), np.zeros(self.bins, bool)
        out[bin_[first]], filled[bin_[first]] = s[first], True
        empty = np.flatnonzero(~filled)
        if len(empty):
            out[empty] = out[self.probe[empty, filled[self.probe[empty]].argmax(1)]]
        return out

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        return mix((signature.reshape(self.bands, self.rows) * self.weight).sum(1, dtype=np.uint64) + self.band_salt).view(np.int64)
