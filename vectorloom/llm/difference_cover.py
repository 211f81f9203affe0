"""Suffix ranks of a string by the difference cover modulo 3, for the strings that one task holds.

Triples at the positions 1 and 2 modulo 3 are sorted and named; the names, first those at positions 1, then those at positions 2, are a
string of two thirds of the length whose suffix ranks come from the same procedure. Any two positions reach sampled ones after
at most two steps, so the remaining suffixes are merged by one symbol (against positions 1) or two (against positions 2) and a known rank.
Ranks are only needed up to a number of symbols, so the recursion ends when a name spans as many.
"""

from __future__ import annotations

import numpy as np


def dense(*columns: np.ndarray) -> np.ndarray:
    """Numbers 0, 1, ... of the rows of the columns (integers >= 0) in lexicographic order, equal rows alike."""
    key, top = columns[0].astype(np.int64), int(columns[0].max(initial=0)) + 1
    for column in columns[1:]:
        size = int(column.max(initial=0)) + 1
        if top * size >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            top = int(key.max(initial=0)) + 1
        key, top = key * size + column, top * size
    if top <= 1 << 24:  # a table of all keys is cheaper than sorting
        there = np.zeros(top, np.int32)
        there[key] = 1
        return (np.cumsum(there) - 1)[key]
    return np.unique(key, return_inverse=True)[1]


def _fewer(keys: np.ndarray, split: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For dense keys of two groups (before and after `split`): per row of the first how many of either group are less, of the second how
    many of the first are."""
    a, b = keys[:split], keys[split:]
    size = int(keys.max(initial=0)) + 1
    less_a = np.concatenate(([0], np.cumsum(np.bincount(a, minlength=size))))
    less_b = np.concatenate(([0], np.cumsum(np.bincount(b, minlength=size))))
    return less_a[a], less_b[a], less_a[b]


def suffix_ranks(symbols: np.ndarray, need: int, span: int = 1) -> np.ndarray:
    """Rank (1 and up) of each suffix of `symbols` (integers >= 1): smaller suffixes have smaller ranks, and ranks tie only if the first
    `need` original symbols are equal; `span` is how many of those one of `symbols` stands for."""
    n = len(symbols)
    if n < 3:
        order = sorted(range(n), key=lambda i: symbols[i:].tolist())
        return np.argsort(np.array(order, np.int64), kind="stable") + 1
    s = np.concatenate((symbols.astype(np.int64), np.zeros(3, np.int64)))
    zero, one, two = (np.arange(k, n, 3) for k in range(3))
    sampled = np.concatenate((one, two))
    names = dense(s[sampled], s[sampled + 1], s[sampled + 2]) + 1
    if 3 * span < need and int(names.max()) < len(names):
        below = suffix_ranks(np.concatenate((names[:len(one)] + 1, [1], names[len(one):] + 1)), need, 3 * span)
        names = np.concatenate((below[:len(one)], below[len(one) + 1:]))
    rank = np.zeros(n + 3, np.int64)
    rank[sampled] = names
    counts = np.bincount(names)
    out = np.empty(n, np.int64)
    out[sampled] = (np.cumsum(counts) - counts)[names]
    with_one = np.concatenate((zero, one))
    own, first, before_one = _fewer(dense(s[with_one], rank[with_one + 1]), len(zero))
    with_two = np.concatenate((zero, two))
    _, second, before_two = _fewer(dense(s[with_two], s[with_two + 1], rank[with_two + 2]), len(zero))
    out[zero] = own + first + second
    out[one] += before_one
    out[two] += before_two
    return out + 1


def repeated_prefixes(data: np.ndarray, starts: np.ndarray, length: int, rows: int = 1 << 15) -> np.ndarray:
    """True for the `starts` in `data` (bytes) whose first `length` bytes begin at another start too: neighbours in suffix order are compared."""
    order = starts[np.argsort(suffix_ranks(data.astype(np.int64) + 1, length)[starts], kind="stable")]
    windows = np.lib.stride_tricks.sliding_window_view(data, length) if len(data) >= length else np.zeros((0, length), np.uint8)
    equal = np.zeros(max(0, len(order) - 1), bool)
    for at in range(0, len(equal), rows):
        part = order[at:at + rows + 1]
        bytes_of = windows[part]
        equal[at:at + len(part) - 1] = (bytes_of[1:] == bytes_of[:-1]).all(1)
    hit = np.zeros(len(order), bool)
    hit[1:] |= equal
    hit[:-1] |= equal
    marked = np.zeros(len(data) + 1, bool)
    marked[order[hit]] = True
    return marked[starts]
