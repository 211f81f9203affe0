"""Lattice codes: random projections of unit vectors, eight numbers at a time, decoded to the nearest point of the E8 lattice."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, product

import numpy as np

#: Neighbours of a point that a block may step to when several blocks are probed together.
STEPS = 8


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest point with whole coordinates of even sum: round, and if the sum is odd round the worst coordinate the other way."""
    point = np.rint(x)
    odd = np.flatnonzero(point.sum(1).astype(np.int64) & 1)
    gap = x[odd] - point[odd]
    worst = np.abs(gap).argmax(1)
    point[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return point


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row of eight: the better of D8 and D8 moved by one half."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


@lru_cache(maxsize=1)
def roots() -> np.ndarray:
    """The 240 neighbours of the origin, and the origin as the last row."""
    found = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            point = np.zeros(8)
            point[[i, j]] = a, b
            found.append(point)
    found += [np.array(signs) / 2 for signs in product((1.0, -1.0), repeat=8) if np.prod(signs) > 0]
    return np.array([*found, np.zeros(8)])


@lru_cache(maxsize=64)
def _table(seed: int, dims: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64]:
    """(projection, shift, multipliers of the hash, start of the hash) of one table."""
    rng = np.random.default_rng([seed, dims, blocks])
    return (rng.normal(size=(dims, 8 * blocks)), rng.random(8 * blocks), rng.integers(1, 1 << 63, (blocks, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(1 << 63, dtype=np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def cells(units: np.ndarray, seed: int, blocks: int, width: float, probes: int = 0) -> np.ndarray:
    """(vectors, 1 + probes) 64-bit names of cells: the vector's own first, then those of the neighbouring lattice points in order of distance.

    A cell is a point of `blocks` copies of E8, `width` times as large. A name is a linear hash of the doubled coordinates, so that a
    neighbour's name is the sum of the point's and the step's.
    """
    projection, shift, factors, start = _table(seed, units.shape[1], blocks)
    places = units @ projection / width + shift
    names, costs = np.full((len(units), 1), start), np.zeros((len(units), 1))
    for block in range(blocks):
        x = places[:, 8 * block:8 * block + 8]
        point = decode(x)
        name = ((2 * point).astype(np.int64).astype(np.uint64) * factors[block]).sum(1)[:, None]
        if probes:
            step_names = ((2 * roots()).astype(np.int64).astype(np.uint64) * factors[block]).sum(1)
            cost = 2 - 2 * (x - point) @ roots().T  # squared distance of the neighbour less that of the point
            cost[:, -1] = 0
            best = np.argpartition(cost, STEPS, 1)[:, :STEPS]
            name, cost = name + step_names[best], np.take_along_axis(cost, best, 1)
            names = (names[:, :, None] + name[:, None, :]).reshape(len(units), -1)
            costs = (costs[:, :, None] + cost[:, None, :]).reshape(len(units), -1)
            order = np.argsort(costs, 1, kind="stable")[:, :1 + probes]
            names, costs = np.take_along_axis(names, order, 1), np.take_along_axis(costs, order, 1)
        else:
            names = names + name
    return _mix(names)
