"""Words and word shingles as 64-bit hashes, for code that runs in Python workers."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

import numpy as np
import xxhash

SHINGLE = 5
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """Hash of each word seen lately; emptied when it holds ``most`` words of up to ``longest`` bytes, so memory stays bounded."""

    most = 150_000
    longest = 64

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = found
        return found


def worker_cache(key: object, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept by a Python worker for its later tasks until another key is asked for."""
    held = sys.modules.setdefault("_weftline_worker", types.ModuleType("_weftline_worker"))
    if getattr(held, "key", None) != key:
        held.value = None
        held.value, held.key = make(), key
    return held.value


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased: what bytes.split and bytes.lower do."""
    return text.lower().split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hash of each run of k words; of the whole sequence if it has fewer; none if there are no words."""
    n = min(k, len(hashes))
    if not n:
        return hashes
    m = len(hashes) - n + 1
    with np.errstate(over="ignore"):
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h = mix(h * _M1 + hashes[i : i + m])
    return h


def shingle_set(text: bytes | None, cache: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingles(word_hashes(words_of(text), cache), k))


_FOLDED = np.arange(256, dtype=np.uint64)
_FOLDED[65:91] += np.uint64(32)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
LONGEST, BYTES = 64, 1 << 15  # bytes of a word that are hashed as sums, and of text that are summed up at once
_BASE = 0x9E3779B97F4A7C17  # 3 modulo 4, so that no two short words differ in few bits of a sum only


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


with np.errstate(over="ignore"):
    _BYTE = mix(mix((_FOLDED + np.uint64(1)) * _M1))
_UP, _DOWN = _powers(_BASE, BYTES + LONGEST), _powers(pow(_BASE, -1, 1 << 64), BYTES + LONGEST)


def located_words(raw: np.ndarray, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (not that of WordHashes), first and end byte of each word ``[^\\x20\\x09-\\x0D]+`` of the bytes, A-Z as a-z.

    Words end where texts do that stand side by side; ``bounds`` has the first bytes of these.
    """
    first, end = bounds_of_words(raw, np.zeros(0, np.int64) if bounds is None else bounds)
    h = np.empty(len(first), np.uint64)
    sums = np.zeros(BYTES + LONGEST + 1, np.uint64)
    with np.errstate(over="ignore"):
        for b in range(0, len(raw), BYTES):
            lo, hi = np.searchsorted(first, [b, b + BYTES])
            values = _BYTE[raw[b : b + BYTES + LONGEST]]
            np.cumsum(values * _UP[: len(values)], out=sums[1 : len(values) + 1])
            f = first[lo:hi] - b
            h[lo:hi] = (sums[np.minimum(end[lo:hi] - b, len(values))] - sums[f]) * _DOWN[f]
        h = mix(h + (end - first).astype(np.uint64) * _M1)
    for i in np.flatnonzero(end - first > LONGEST):
        h[i] = xxhash.xxh3_64_intdigest(raw[first[i] : end[i]].tobytes().lower())
    return h, first, end


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one text after the other, and their numbers, by the hashes of located_words; text i is the bytes from ``bounds`` i to i + 1."""
    h, at, _ = located_words(raw, bounds)
    first = np.searchsorted(at, bounds)
    counts = np.diff(first)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    rows, ends = np.repeat(np.arange(len(n)), n), np.cumsum(n)
    s = np.zeros(len(rows), np.uint64)
    whole = counts >= k
    if whole.any():
        at = np.arange(len(rows)) + np.repeat(first[:-1] - ends + n, n)
        full = whole[rows]
        s[full] = shingles(h, k)[at[full]]
    for i in np.flatnonzero((counts > 0) & ~whole):
        s[ends[i] - 1] = shingles(h[first[i] : first[i + 1]], k)[0]
    s = s[np.lexsort((s, rows))]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (rows[1:] != rows[:-1])
    return s[keep], np.bincount(rows[keep], minlength=len(n))


def bounds_of_words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each word ``[^\\x20\\x09-\\x0D]+`` of texts that stand side by side; text i is the bytes from ``bounds`` i to i + 1."""
    inside = ~_SPACE[raw]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    at = bounds[(bounds > 0) & (bounds < len(raw))]
    opens[at], closes[at - 1] = inside[at], inside[at - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


_LOWER = _FOLDED.astype(np.uint8)
_SECRET = np.frombuffer(bytes.fromhex("b8fe6c3923a44bbe7c01812cf721ad1cded46de9839097db7240a4a4b7b3671fcb79e64eccc0e578825ad07dccff7221b8084674f743248e"), "<u8")
_FLIP_3 = (_SECRET[0] & np.uint64(0xFFFFFFFF)) ^ (_SECRET[0] >> np.uint64(32))
_FLIP_8, _FLIP_LO, _FLIP_HI = _SECRET[1] ^ _SECRET[2], _SECRET[3] ^ _SECRET[4], _SECRET[5] ^ _SECRET[6]


def _rotated(h: np.ndarray, by: int) -> np.ndarray:
    return (h << np.uint64(by)) | (h >> np.uint64(64 - by))


def _folded_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Both halves of the 128-bit product, xored."""
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    a0, a1, b0, b1 = a & low, a >> half, b & low, b >> half
    cross = a1 * b0 + (a0 * b0 >> half)
    other = a0 * b1 + (cross & low)
    return (a * b) ^ (a1 * b1 + (cross >> half) + (other >> half))


def hashes_of_words(raw: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of WordHashes (xxh3 with A-Z as a-z) of each word of the bytes, all of a length class at once; longer words one by one."""
    raw = _LOWER[np.concatenate([raw, np.zeros(8, np.uint8)])]
    read = lambda kind, at: np.ndarray((len(raw) - 7,), kind, raw, 0, (1,))[at].astype(np.uint64)
    size, out = end - first, np.empty(len(first), np.uint64)
    u = np.uint64
    with np.errstate(over="ignore"):
        i = np.flatnonzero(size <= 3)
        a, n = first[i], size[i]
        h = ((raw[a].astype(u) << u(16)) | (raw[a + (n >> 1)].astype(u) << u(24)) | raw[a + n - 1] | (n.astype(u) << u(8))) ^ _FLIP_3
        h = (h ^ (h >> u(33))) * u(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> u(29))) * u(0x165667B19E3779F9)
        out[i] = h ^ (h >> u(32))
        i = np.flatnonzero((size > 3) & (size <= 8))
        a, n = first[i], size[i]
        h = (read("<u4", a + n - 4) + (read("<u4", a) << u(32))) ^ _FLIP_8
        h = (h ^ _rotated(h, 49) ^ _rotated(h, 24)) * u(0x9FB21C651E98DF25)
        h = (h ^ ((h >> u(35)) + n.astype(u))) * u(0x9FB21C651E98DF25)
        out[i] = h ^ (h >> u(28))
        i = np.flatnonzero((size > 8) & (size <= 16))
        a, n = first[i], size[i]
        lo, hi = read("<u8", a) ^ _FLIP_LO, read("<u8", a + n - 8) ^ _FLIP_HI
        h = n.astype(u) + lo.byteswap() + hi + _folded_product(lo, hi)
        h = (h ^ (h >> u(37))) * u(0x165667919E3779F9)
        out[i] = h ^ (h >> u(32))
    for i in np.flatnonzero(size > 16).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[first[i] : end[i]])
    return out


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit hash of an array of hashes."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def minhash_keys(pool: np.ndarray, index: np.ndarray, keys: int, rows: int = 2, step: int = 1) -> np.ndarray:
    """A row of ``keys`` hashes, each of ``rows`` MinHash values and its own number, for each set in a pool.

    Sets begin at the index; with a step of 2, every other index is an end instead.
    """
    out = np.empty((-(-len(index) // step), keys), np.uint64)
    with np.errstate(over="ignore"):
        seeds = mix(np.arange(1, keys * rows + 1, dtype=np.uint64) * _M1)
        for k in range(keys):
            h = np.full(len(out), k + 1, np.uint64)
            for seed in seeds[k * rows : (k + 1) * rows]:
                h = mix(h * _M1 + np.minimum.reduceat(mix(pool ^ seed), index)[::step])
            out[:, k] = h
    return out
