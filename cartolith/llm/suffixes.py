"""Suffix order and longest previous factors of byte strings, in whole arrays."""

from __future__ import annotations

import numpy as np


def ranks(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(width, rank) of the substrings at each place, for widths 8, 16, ... up to ``length`` (8 at least), by prefix doubling.

    Beyond the end bytes count as 0. The first entry holds the 8 bytes themselves.
    """
    word, shift = data.astype(np.uint64), 1
    while shift < 8:
        after = np.zeros_like(word)
        after[:-shift] = word[shift:]
        word = word << np.uint64(8 * shift) | after
        shift *= 2
    levels, width, rank = [(8, word)], 8, _dense(word)
    while 2 * width <= length:
        rank = _pair_rank(rank, width)
        width *= 2
        levels.append((width, rank))
    return levels


def _dense(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.uint64)


def _pair_rank(rank: np.ndarray, ahead: int) -> np.ndarray:
    """Ranks by (rank here, rank ``ahead`` places on)."""
    after = np.zeros_like(rank)
    after[:-ahead] = rank[ahead:] + np.uint64(1)
    return _dense(rank * np.uint64(len(rank) + 2) + after)


def suffix_order(levels: list[tuple[int, np.ndarray]], at: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """The order of the suffixes at ``at`` by their first ``length`` bytes, then by ``place``."""
    width, rank = levels[-1]
    return np.lexsort((place, rank[at + length - width], rank[at]))


def common_prefix(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """How many first bytes, up to ``length``, the substrings at ``a`` and ``b`` share."""
    got = np.zeros(len(a), np.int64)
    top = levels[0][1]
    last = len(top) - 1
    for width, rank in reversed(levels):
        for _ in range(2 if width == levels[-1][0] else 1):
            same = (got + width <= length) & (rank[np.minimum(a + got, last)] == rank[np.minimum(b + got, last)])
            got[same] += width
    apart = top[np.minimum(a + got, last)] ^ top[np.minimum(b + got, last)]
    for k in range(1, 8):  # the bytes of the word that differs
        got += (apart >> np.uint64(64 - 8 * k)) == 0
    return np.minimum(got, length)


def _smaller_before(place: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """The prefix shared with the nearest suffix before, in suffix order, of smaller ``place``; 0 if that is less than ``least``.

    ``lcp[i]`` is what suffixes i - 1 and i share. Each suffix looks at the one before it, and, while
    that has no smaller place, jumps to where that one has got to, with the least of the prefixes on the way.
    """
    n = len(place)
    to, low = np.arange(n) - 1, lcp.copy()
    live = np.flatnonzero((to >= 0) & (low >= least))
    low[lcp < least] = 0
    while len(live):
        live = live[place[to[live]] >= place[live]]
        step, low_step = to[to[live]], low[to[live]]
        to[live], low[live] = step, np.minimum(low[live], low_step)
        over = (step < 0) | (low[live] < least)
        low[live[over]] = 0
        to[live[over]] = -1
        live = live[~over]
    low[to < 0] = 0
    return low


def longest_previous(place: np.ndarray, lcp: np.ndarray, least: int = 1) -> np.ndarray:
    """The longest previous factor of each suffix, in suffix order: what it shares with one of smaller ``place``.

    It is the greater of the prefixes shared with the previous and the next smaller place in suffix
    order. Factors shorter than ``least`` count as 0. Suffixes of equal place are not previous to each other.
    """
    before = _smaller_before(place, lcp, least)
    back = np.concatenate([[0], lcp[:0:-1]]) if len(lcp) else lcp
    after = _smaller_before(place[::-1], back, least)[::-1]
    return np.maximum(before, after)
