"""Vectorised word shingles and MinHash signatures over Arrow text buffers."""

from __future__ import annotations

import numpy as np

K = 5
#: Permutations of a signature, of which the first BANDS * ROWS make the bands.
PERMUTATIONS = 768
#: A pair at similarity .75 misses all bands with chance (1 - .75^4)^32 = 5e-6.
BANDS, ROWS = 32, 4

_rng = np.random.default_rng(20240117)
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(1, 1 << 63, K, np.uint64) | np.uint64(1)
_SHORT = _rng.integers(1, 1 << 63, K, np.uint64)
_FACTORS = _rng.integers(1, 1 << 63, PERMUTATIONS, np.uint64) | np.uint64(1)
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 4096), _BASE)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit over the word (in place)."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word (A-Z lower-cased) and the document each is in."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~_SPACE[raw]
    first = np.zeros(n, bool)
    first[0] = True
    first[1:] = ~solid[:-1]
    inner = offsets[:-1]
    first[inner[inner < n]] = True
    starts = np.flatnonzero(solid & first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    spans = np.diff(np.append(starts, n))
    place = np.arange(starts[0], n) - np.repeat(starts, spans)
    value = _BYTE[raw[starts[0] :]]
    value *= _power(int(spans.max()))[place]
    words = mix(np.add.reduceat(value, starts - starts[0]))
    return words, np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each document's sorted distinct shingle hashes; shorter sequences count whole."""
    words, doc = word_hashes(raw, offsets)
    bounds = np.searchsorted(doc, np.arange(len(offsets)))
    n = len(words) - K + 1
    if n > 0:
        all_ = words[:n] * _PLACE[0]
        for k in range(1, K):
            all_ += words[k : n + k] * _PLACE[k]
        mix(all_)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= K:
            out.append(np.unique(all_[a : b - K + 1]))
        elif b > a:
            whole = (words[a:b] * _PLACE[: b - a]).sum(keepdims=True) + _SHORT[b - a]
            out.append(mix(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(documents, permutations) low bytes of the minimum hashes, and (documents, bands) bucket keys."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    sign = np.zeros((len(sets), PERMUTATIONS), np.uint8)
    keys = np.zeros((len(sets), BANDS), np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([sets[i] for i in full])
        starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
        got = np.empty((PERMUTATIONS, len(full)), np.uint32)
        held = np.empty_like(flat)
        for k in range(PERMUTATIONS):
            np.multiply(flat, _FACTORS[k], out=held)
            got[k] = np.minimum.reduceat(held, starts) >> np.uint64(32)
        sign[full] = got.T.astype(np.uint8)
        band = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None], len(full), axis=1)
        for r in range(ROWS):
            band = mix(band * _BASE + got[r : BANDS * ROWS : ROWS])
        keys[full] = band.T.view(np.int64)
    return sign, keys


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of shingles, whatever its order."""
    a = mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()
    b = mix(s + np.uint64(0x5851F42D4C957F2D)).sum()
    return int(a.view(np.int64)), int(b.view(np.int64))
