"""Common prefixes by breadth-first backward extension on a Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Places of the suffixes in their order, by prefix doubling."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, step = len(text), 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - step] = rank[step:] + 1
        names, rank = np.unique(rank * (n + 1) + nxt, return_inverse=True)
        if len(names) == n or step > n:
            break
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def prefix_intervals(text: np.ndarray, separators: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, interval of each of its places): suffixes in one interval share `least` symbols.

    Symbols below `separators` occur once each and end strings: no common prefix goes over them.

    An interval of the suffix array stands for the suffixes that begin with a string. Extending it
    by a symbol to the left gives the interval of the longer string, which ends where a common
    prefix is no longer than the string before the extension. Level by level this derives the
    places where the common prefix with the suffix before is 0, 1, 2, ...; a place is settled once,
    and only intervals that settled a place are extended. After level least - 1 the places that
    are not settled are those with a common prefix of `least` symbols or more.
    """
    n = len(text)
    order = suffix_array(text)
    bwt = text[order - 1].astype(np.int64)
    # place of (symbol, rank) among all: first row of the symbol plus its occurrences before rank
    occurrences = np.sort(bwt * n + np.arange(n))
    settled = np.zeros(n + 1, bool)
    settled[0] = settled[n] = True
    low, high = np.array([0]), np.array([n])
    for level in range(least):
        width = high - low
        inside = np.repeat(low - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        symbols = bwt[inside]
        owner = np.repeat(np.arange(len(low)), width)
        if level:  # the suffixes that begin with a separator were settled at level 0
            real = symbols >= separators
            symbols, owner = symbols[real], owner[real]
        wide = owner * (int(text.max()) + 1) + symbols
        wide = np.unique(wide)
        owner, symbols = np.divmod(wide, int(text.max()) + 1)
        a = np.searchsorted(occurrences, symbols * n + low[owner])
        b = np.searchsorted(occurrences, symbols * n + high[owner])
        new = ~settled[b] | (b == n) & (level == 0)
        settled[b] = True
        low, high = a[new], b[new]
        if not len(low):
            break
    return order, np.cumsum(settled[:n])
