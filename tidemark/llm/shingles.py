"""Sets of word shingles as hashes, and their minhash signatures, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64)
_PLACE = _rng.integers(1, 1 << 63, WORDS, np.uint64) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(which: int, n: int) -> np.ndarray:
    """Powers 0 to n-1 of the base (0) or its inverse (1) modulo 2**64."""
    if len(_powers[which]) < n:
        steps = np.full(max(n, 65536), (_BASE, _INVERSE)[which], np.uint64)
        steps[0] = 1
        _powers[which] = np.cumprod(steps)
    return _powers[which][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words, A-Z lowered; words are runs outside ``[\\x20\\x09-\\x0D]``."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    edge = np.diff(np.concatenate([[True], _WHITE[data], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _grown(0, len(data)))])
    return mix((total[ends] - total[starts]) * _grown(1, len(data))[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's five-word shingles; of a shorter text, one for all its words."""
    words = word_hashes(text or "")
    n = len(words)
    if n == 0:
        return words
    if n < WORDS:
        return mix((words * _PLACE[:n]).sum(keepdims=True) + np.uint64(n))
    runs = words[: n - WORDS + 1] * _PLACE[0]
    for i in range(1, WORDS):
        runs = runs + words[i : n - WORDS + 1 + i] * _PLACE[i]
    return np.unique(mix(runs))


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


PARITY_WORDS = 16


def parity(shingles: np.ndarray) -> np.ndarray:
    """1024 parity bits in 16 words. Two sets' words differ in at most as many bits as the sets differ in members."""
    odd = np.bincount((shingles & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


class TensorHasher:
    """Two collections of ``groups`` keys, each key hashing ``rows`` minhashes.

    A table of tensored banding is keyed by one key of each collection: groups**2 tables from only
    2*groups*rows minhashes. Texts of similarity s share a table with probability
    (1 - (1 - s**rows)**groups)**2.
    """

    def __init__(self, groups: int, rows: int, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        n = 2 * groups * rows
        self.groups, self.rows = groups, rows
        self.a = (rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, n, np.uint32)[:, None]
        self.place = rng.integers(1, 1 << 63, rows, np.uint64) | np.uint64(1)
        self.band = rng.integers(1, 1 << 63, 2 * groups, np.uint64)

    def keys(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for lo in range(0, len(x), 1024):
            np.minimum(low, (self.a * x[lo : lo + 1024] + self.b).min(axis=1), out=low)
        keys = mix((low.reshape(-1, self.rows) * self.place).sum(axis=1) + self.band).astype(np.int64)
        return keys[: self.groups], keys[self.groups :]
