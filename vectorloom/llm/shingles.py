"""Sets of hashed word shingles of whole texts, vectorised over blocks of texts."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: A word ends at these bytes (fixed values: the blanks of the contract).
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0 to n - 1 of the rolling base, or of its inverse, modulo 2**64; tables grow by doubling."""
    size = 1 << max(20, (n - 1).bit_length())
    return _powers(size, pow(_BASE, -1, 1 << 64) if inverse else _BASE)[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    # fixed values: a 64-bit finaliser
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit hash) of every word of the texts, A-Z in lower case."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[_LOWER[data]] * powers(len(data)), out=running[1:])
    hashes = mixed((running[ends] - running[starts]) * powers(len(data), inverse=True)[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return np.searchsorted(bounds, starts, "right"), hashes


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingles (int64) of each text; a text of fewer words is one shingle, one without words has none."""
    text, words = word_hashes(texts)
    counts = np.bincount(text, minlength=len(texts))
    ends = np.cumsum(counts)
    joined = words.copy()
    with np.errstate(over="ignore"):
        for step in range(1, width):
            joined[:-step] = joined[:-step] * np.uint64(0xD6E8FEB86659FD93) + np.roll(words, -step)[:-step]
        joined = mixed(joined).view(np.int64)
        out = []
        for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
            if n >= width:
                out.append(np.unique(joined[end - n:end - width + 1]))
            elif n:
                whole = np.uint64(n)
                for w in words[end - n:end]:
                    whole = whole * np.uint64(0xD6E8FEB86659FD93) + w
                out.append(mixed(np.array([whole], np.uint64)).view(np.int64))
            else:
                out.append(np.zeros(0, np.int64))
    return out
