"""Word shingles, MinHash samples and odd sketches of a batch of texts, in numpy.

All functions take and return flat arrays with offsets, so a batch of texts costs a fixed number of numpy calls.
"""

from __future__ import annotations

import hashlib

import numpy as np

SHINGLE = 5
_U = np.uint64


def _words(seed: int, shape) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, shape, dtype=_U)


_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A random number for each byte value at each of 64 places of a word; places from 64 on are multiplied further.
_PLACES = 64
_TABLE = _words(11, (_PLACES, 256))
_FAR = _words(12, 1)[0] | _U(1)
_STEP = _words(13, SHINGLE) | _U(1)
_SHORT = _words(14, SHINGLE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts, A-Z lower-cased, and how many words each text has."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    solid = ~_IS_WHITE[joined]
    edge = np.diff(solid.view(np.int8), prepend=np.int8(0))
    starts = np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, _U), np.zeros(len(texts), np.int64)
    lens = np.flatnonzero(edge == -1) - starts
    first = np.cumsum(lens) - lens
    own = _LOWER[joined[solid]]
    place = np.arange(len(own)) - np.repeat(first, lens)
    parts = _TABLE[place % _PLACES, own]
    if lens.max() > _PLACES:
        far = np.ones(int(lens.max()) // _PLACES + 1, _U)
        far[1:] = _FAR
        parts *= np.multiply.accumulate(far)[place // _PLACES]
    hashes = mix(np.add.reduceat(parts, first) + lens.astype(_U) * _FAR)
    return hashes, np.diff(np.searchsorted(starts, np.append(begins, len(joined))))


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, repeats included, and how many each text has: the 5-word windows, or the
    whole sequence where a text has fewer words."""
    hashes, counts = word_hashes(texts)
    if not len(hashes):
        return hashes, counts
    ends = np.cumsum(counts)
    begins = ends - counts
    out_counts = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    padded = np.concatenate((hashes, np.zeros(SHINGLE, _U)))
    total = np.zeros(len(hashes), _U)
    for k in range(SHINGLE):
        total += padded[k : k + len(hashes)] * _STEP[k]
    text_of = np.repeat(np.arange(len(texts)), counts)
    whole = np.arange(len(hashes)) + SHINGLE <= ends[text_of]
    keep = whole.copy()
    for t in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        n, b = int(counts[t]), int(begins[t])
        total[b : b + 1] = (hashes[b : b + n] * _STEP[:n]).sum(dtype=_U, keepdims=True) + _SHORT[n : n + 1]
        keep[b] = True
    return mix(total[keep]), out_counts


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, counts = shingle_hashes(texts)
    return [np.unique(x) for x in np.split(hashes, np.cumsum(counts)[:-1])] if texts else []


class Sketcher:
    """MinHash samples of shingle sets, the keys of their bands, and their odd sketches."""

    def __init__(self, bands: int, rows: int, bits: int):
        self.bands, self.rows, self.bits = bands, rows, bits
        k = bands * rows
        self.mul, self.add = _words(21, k) | _U(1), _words(22, k)
        self.row, self.band, self.sample = _words(23, rows) | _U(1), _words(24, bands), _words(25, k)

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row for each set (none may be empty), a column for each sample."""
        out = np.empty((len(sets), self.bands * self.rows), _U)
        at = 0
        while at < len(sets):
            to, size = at, 0
            while to < len(sets) and (to == at or size + len(sets[to]) <= 32_768):  # fits the CPU's cache
                size += len(sets[to])
                to += 1
            part = np.concatenate(sets[at:to])
            offsets = np.cumsum([0, *map(len, sets[at : to - 1])])
            work = np.empty_like(part)
            for j in range(out.shape[1]):
                np.multiply(part, self.mul[j], out=work)
                np.add(work, self.add[j], out=work)
                out[at:to, j] = np.minimum.reduceat(work, offsets)
            at = to
        return out

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        by_band = minima.reshape(len(minima), self.bands, self.rows)
        return mix((mix(by_band) * self.row).sum(axis=2, dtype=_U) + self.band).view(np.int64)

    def odd(self, minima: np.ndarray) -> np.ndarray:
        """Odd sketch: each sample flips the bit that its value hashes to, so a bit holds a parity."""
        bit = (mix(minima + self.sample) % _U(self.bits)).astype(np.int64)
        flat = bit + np.arange(len(minima))[:, None] * self.bits
        flips = np.bincount(flat.ravel(), minlength=len(minima) * self.bits)
        return np.packbits((flips & 1).astype(np.uint8).reshape(len(minima), self.bits), axis=1)

    def estimate(self, differing: np.ndarray) -> np.ndarray:
        """Similarity from the population count of the XOR of two odd sketches of k samples in n bits."""
        n, k = self.bits, self.bands * self.rows
        inside = np.maximum(1 - 2 * differing / n, 1e-9)
        return 1 + n / (4 * k) * np.log(inside)


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
