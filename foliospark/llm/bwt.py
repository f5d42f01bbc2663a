"""Repeated substrings from a Burrows-Wheeler transform, without a table of common prefixes.

The transform is built from suffixes ordered by their first symbols (as many as are asked
about).  Breadth-first backward extension then visits the intervals of ever longer strings:
an interval of length l whose right border has no value yet fixes the common prefix there at
l - 1, and only such intervals are extended further.  So values appear in increasing order,
and after ``length`` rounds the borders still without a value are exactly those where
neighbouring suffixes share at least ``length`` symbols.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first ``depth`` symbols at least (symbols from 0 to 511; past the end counts as least)."""
    n = len(text)
    symbols = text.astype(np.int64) + 1
    key = np.zeros(n, np.int64)
    have = 6  # 6 symbols of 10 bits
    for i in range(have):
        key <<= 10
        key[: max(0, n - i)] |= symbols[i:]
    while True:
        order = np.argsort(key, kind="stable" if n < 64 else None)
        ranked = key[order]
        new = np.empty(n, bool)
        new[0] = False
        np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if have >= depth or rank[order[-1]] == n - 1:
            break
        key = rank << 32
        key[: max(0, n - have)] |= rank[have:] + 1
        have *= 2
    # Ties go to the earlier suffix, so that extension by one symbol keeps their order.
    return np.argsort(rank, kind="stable") if rank[order[-1]] != n - 1 else order


def classes(text: np.ndarray, length: int) -> np.ndarray:
    """A number for each position, the same where the ``length`` symbols from there are the same."""
    n = len(text)
    if n < 2:
        return np.zeros(n, np.int64)
    order = suffix_order(text, length + 2)
    bwt = text[order - 1].astype(np.int64)  # cyclic; a separator ends the text
    follow = np.empty(n, np.int64)
    follow[np.argsort(bwt.astype(np.uint16), kind="stable")] = np.arange(n)
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(length):
        single = high - low == 1
        at = low[single]
        new_low, new_high = [follow[at]], [follow[at] + 1]
        low, high = low[~single], high[~single]
        if len(low):
            size = high - low
            which = np.repeat(np.arange(len(low)), size)
            at = np.arange(len(which)) + np.repeat(low - (np.cumsum(size) - size), size)
            key = which * 512 + bwt[at]
            by = np.argsort(key, kind="stable")
            key = key[by]
            cut = np.flatnonzero(key[1:] != key[:-1])
            first, last = at[by[np.concatenate([[0], cut + 1])]], at[by[np.concatenate([cut, [len(by) - 1]])]]
            new_low.append(follow[first])
            new_high.append(follow[last] + 1)
        low, high = np.concatenate(new_low), np.concatenate(new_high)
        fresh = unset[high]
        low, high = low[fresh], high[fresh]
        unset[high] = False
        if not len(low):
            break
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(~unset[:n])  # border i lies between suffixes i - 1 and i
    return out


def repeated(text: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` symbols at each position also start at another position."""
    own = classes(text, length)
    return np.bincount(own)[own] > 1
