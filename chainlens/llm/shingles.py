"""Words, hashed shingle sets and circulant MinHash signatures of one text (numpy)."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
COORDS = 128          # signature length
ROWS = 4              # coordinates per band: 32 bands, recall 0.99999 at similarity 0.75
UNIVERSE_BITS = 20

# Odd multipliers of the shingle polynomial; any fixed odd numbers do.
_ODD = np.random.default_rng(20240607).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that hashes that differ stay different."""
    x = x.copy()
    for shift, odd in ((30, _ODD[13]), (27, _ODD[14])):
        x ^= x >> np.uint64(shift)
        x *= odd
    x ^= x >> np.uint64(31)
    return x


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; ``bytes`` methods touch ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` words, by position."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(k if n > 0 else 0):
        out += h[j:j + n] * _ODD[j]
    return mix(out)


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct ``k``-word shingles as 64-bit hashes; a shorter text is one shingle."""
    h = word_hashes(words(text))
    if len(h) == 0:
        return np.zeros(0, np.uint64)
    if len(h) < k:
        return mix(windows(h, len(h)) ^ _ODD[10 + len(h) % 3])
    return np.unique(windows(h, k))


class Circulant:
    """Two permutations give every coordinate of a signature.

    The first (the hash itself, cut to ``UNIVERSE_BITS``) places a shingle in the universe;
    the second, ``pi``, is drawn once from a fixed seed.  Coordinate ``k`` is the minimum of
    ``pi`` shifted circularly by ``k``, so the coordinates of one shingle are a run of ``pi``
    and a signature is the element-wise minimum of such runs.
    """

    def __init__(self, coords: int = COORDS, rows: int = ROWS, seed: int = 7):
        size = 1 << UNIVERSE_BITS
        pi = np.random.default_rng(seed).permutation(size).astype(np.uint32)
        self.runs = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:coords]]), coords)
        self.coords, self.rows = coords, rows
        self.salt = mix(np.arange(1, coords // rows + 1, dtype=np.uint64))

    def place(self, grams: np.ndarray) -> np.ndarray:
        return (grams >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)

    def signature(self, grams: np.ndarray, block: int = 2048) -> np.ndarray:
        at = self.place(grams)
        out = np.full(self.coords, np.iinfo(np.uint32).max, np.uint32)
        for i in range(0, len(at), block):
            np.minimum(out, self.runs[at[i:i + block]].min(axis=0), out=out)
        return out

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        """One 64-bit key per band; ``signatures`` is (..., coords)."""
        s = signatures.reshape(*signatures.shape[:-1], self.coords // self.rows, self.rows).astype(np.uint64)
        key = np.broadcast_to(self.salt, s.shape[:-1]).copy()
        for j in range(self.rows):
            key = mix(key * _ODD[j] + s[..., j])
        return key.view(np.int64)


def fingerprint(grams: np.ndarray) -> tuple[int, int]:
    """128 bits of a whole set, as two signed longs: equal sets collapse to one node."""
    d = np.frombuffer(xxhash.xxh3_128_digest(grams.tobytes()), np.int64)
    return int(d[0]), int(d[1])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
