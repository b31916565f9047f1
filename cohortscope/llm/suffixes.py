"""Suffix arrays of many token sequences at once, in numpy.

Prefix doubling over the positions that are still tied: a position leaves the work as soon
as its suffix is unique, so a text without repetition costs one sort.  Ranks are kept per
level, and common prefixes are read off them from the longest level down.
"""

from __future__ import annotations

import numpy as np


def suffix_array(tokens: np.ndarray, sequence: np.ndarray):
    """Order of the suffixes and the common prefix of neighbours.

    ``tokens`` are non-negative integers; ``sequence`` numbers, in ascending order, the
    sequence that each belongs to.  Suffixes end with their sequence, and only suffixes of
    one sequence are compared: neighbours from different sequences share nothing.
    Returns (positions in suffix order, length shared with the one before).
    """
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.flatnonzero(np.r_[sequence[1:] != sequence[:-1], True]) + 1
    end = np.repeat(ends, np.diff(np.r_[0, ends]))
    key = sequence.astype(np.int64) * (int(tokens.max()) + 1) + tokens
    order = np.argsort(key, kind="stable")
    slots, rank = np.arange(n), np.empty(n, np.int64)
    levels, width = [], 1
    key = key[order]
    while True:
        new = np.r_[True, key[1:] != key[:-1]]
        first = np.flatnonzero(new)
        group = np.repeat(slots[first], np.diff(np.r_[first, len(slots)]))
        rank[order[slots]] = group
        levels.append(rank.astype(np.int32))
        tied = ~(new & np.r_[new[1:], True])
        slots = slots[tied]
        if not len(slots):
            break
        at = order[slots]
        after = at + width
        inside = after < end[at]
        key = group[tied] * (n + 1) + np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        o = np.argsort(key, kind="stable")
        order[slots], key = at[o], key[o]
        width *= 2
    return order, _common(order, levels, end, n)


def _common(order, levels, end, n):
    common = np.zeros(n, np.int64)
    pair = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    i, j = order[pair - 1].copy(), order[pair].copy()
    stop_i, stop_j = end[i], end[j]
    for level in range(len(levels) - 1, -1, -1):
        r = levels[level]
        same = (i < stop_i) & (j < stop_j)
        same &= r[np.minimum(i, n - 1)] == r[np.minimum(j, n - 1)]
        step = np.where(same, 1 << level, 0)
        common[pair] += step
        i += step
        j += step
    return common


def intervals(common: np.ndarray, least: int):
    """Common-prefix intervals of at least ``least``, by a stack scan.

    Returns lengths, first and last places in suffix order, parents (-1: none), and for each
    place the interval whose length it shares with the one before (-1: below ``least``).
    """
    length, first, last, parent = [], [], [], []
    owner = np.full(len(common), -1)
    stack: list[int] = []
    places = np.flatnonzero(common >= least)

    def close(upto: int, place: int) -> int:
        """Pop the intervals longer than ``upto``; the first place of the last one."""
        low = place - 1
        while stack and length[stack[-1]] > upto:
            low_id = stack.pop()
            last[low_id], low = place - 1, first[low_id]
            # hangs on the next longer one: what stays below, or what will be opened here
            parent[low_id] = (stack[-1] if stack and length[stack[-1]] >= upto
                              else len(length) if upto >= least else -1)
        return low

    before = -2
    for place, shared in zip(places.tolist(), common[places].tolist()):
        if place != before + 1:
            close(0, before + 1)
        low = close(shared, place)
        if not stack or length[stack[-1]] < shared:
            stack.append(len(length))
            length.append(shared), first.append(low), last.append(-1), parent.append(
                stack[-2] if len(stack) > 1 else -1)
        owner[place] = stack[-1]
        before = place
    close(0, before + 1)
    return (*[np.array(x, np.int64) for x in (length, first, last, parent)], owner)


def maximal_repeats(tokens, sequence, order, common, least: int) -> np.ndarray:
    """For each position, the longest maximal repeat of at least ``least`` that starts there.

    An interval's prefix cannot be longer to the right; it is a maximal repeat if its
    occurrences are also preceded by different tokens, or one by none.
    """
    out = np.zeros(len(order), np.int64)
    length, first, last, parent, owner = intervals(common, least)
    if not len(length):
        return out
    begins = np.r_[True, sequence[1:] != sequence[:-1]]
    left = np.where(begins, -1, np.r_[-1, tokens[:-1]])[order]
    change = np.cumsum(np.r_[False, left[1:] != left[:-1]])
    maximal = change[last] > change[first]
    longest = np.where(maximal, length, 0)
    for i in np.argsort(length, kind="stable"):         # parents are shorter
        if not maximal[i] and parent[i] >= 0:
            longest[i] = longest[parent[i]]
    held = np.r_[longest, 0][owner]
    out[order] = np.maximum(held, np.r_[held[1:], 0])
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in the union of the given spans."""
    change = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(change[:n]) > 0
