"""Content-defined positions of byte strings, and hashes of any of their substrings, vectorised over blocks of texts.

The positions are a local sample: of every `reach` successive k-grams the one with the least hash (the last of equals) is taken. What is taken
depends on nothing outside the reach + k - 1 bytes looked at, so equal strings of that length have the same sampled positions.
"""

from __future__ import annotations

import numpy as np

from vectorloom.llm.shingles import mixed, powers

_CODES = np.random.default_rng([20240607, 4]).integers(1, 1 << 63, (2, 256), dtype=np.uint64)


class Substrings:
    """128-bit hashes of substrings of `data` as pairs of 64-bit numbers."""

    def __init__(self, data: np.ndarray):
        self.running = []
        self.inverse = powers(len(data) + 1, inverse=True)
        for codes in _CODES:
            running = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(codes[data] * powers(len(data)), out=running[1:])
            self.running.append(running)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        r = self.running[which]
        return mixed((r[ends] - r[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64)).view(np.int64)


def window_picks(keys: np.ndarray, reach: int) -> np.ndarray:
    """For each window of `reach` successive keys the position of its least key (by the upper half of its bits), the last of equals."""
    n = len(keys) - reach + 1
    low = (keys >> np.uint64(32) << np.uint64(32)) | (np.uint64(len(keys) - 1) - np.arange(len(keys), dtype=np.uint64))
    width = 1
    while 2 * width <= reach:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[reach - width:reach - width + n])
    return (len(keys) - 1) - (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
