"""Repeated substrings of a set of byte strings from a Burrows-Wheeler transform: the per-task step of suffix-array deduplication."""

from __future__ import annotations

import numpy as np


def _ranked(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Dense ranks (from 0) of keys, given their sorting order."""
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.concatenate([[0], np.cumsum(keys[order][1:] != keys[order][:-1])])
    return ranks


def bounded_suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first `depth` symbols or more, and their ranks; those that agree so far share a rank.

    Prefix doubling: ranks of twice as many symbols come from two ranks each.
    """
    n, bits = len(symbols), max(int(symbols.max(initial=0)).bit_length(), 1)
    known = min(max(60 // bits, 1), depth)
    padded = np.concatenate([symbols, np.zeros(known, np.int64)])
    keys = np.zeros(n, np.int64)
    for k in range(known):
        keys = keys << bits | padded[k : k + n]
    order = np.argsort(keys)
    ranks = _ranked(keys, order)
    while known < depth and ranks[order[-1]] < n - 1:
        later = np.zeros(n, np.int64)
        later[: n - known] = ranks[known:] + 1
        keys = ranks * (n + 1) + later
        order = np.argsort(keys)
        ranks = _ranked(keys, order)
        known *= 2
    return order, ranks


def _spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All positions of the half-open intervals, which ascend and don't overlap."""
    sizes = ends - starts
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def common_prefixes(order: np.ndarray, ranks: np.ndarray, symbols: np.ndarray, separators: int, limit: int) -> np.ndarray:
    """For each place in the order, the length of the common prefix with the place before it, or `limit` if that is longer.

    Interval expansion: the places at which the prefixes of length l end are known; an interval that they split is extended backward by each
    symbol before its suffixes, and where two neighbours of one extended interval lie on both sides of a split, their common prefix has
    length l + 1. Lengths appear in ascending order, each place is set once, and what is not set below `limit` is not looked at any more.
    """
    n = len(order)
    found = np.full(n, limit, np.int64)
    before = np.where(order > 0, symbols[order - 1], 0)
    usable = (order > 0) & (before >= separators)  # nothing matches across a separator
    first = np.flatnonzero(np.concatenate([[True], ranks[order][1:] != ranks[order][:-1]]))
    head = np.zeros(n, np.int64)
    head[first] = first
    head = np.maximum.accumulate(head)  # first place of the suffixes that agree to the full depth
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    target = head[place[order - 1]]

    leading = symbols[order]
    new = np.flatnonzero(np.concatenate([[True], leading[1:] != leading[:-1]]))
    found[new] = 0
    new = new[1:]
    start, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    end[0] = n
    shift = max(n.bit_length(), 1)
    for length in range(limit - 1):
        if not len(new):
            break
        parents = np.unique(start[new])
        ends = end[parents]
        at = _spans(parents, ends)
        split = found[at] == length
        split &= start[at] != at  # a parent's own first place was set before
        part = np.cumsum(split)
        # children of the split intervals
        opens = split | (start[at] == at)
        heads = at[opens]
        lasts = np.append(np.flatnonzero(opens)[1:], len(at)) - 1
        own = np.repeat(start[at[opens]], lasts + 1 - np.flatnonzero(opens))
        # backward extension: suffixes of one parent by the symbol before them, in order
        used = np.flatnonzero(usable[at])
        keys = (own_number(own, used) << 9 | (before[at[used]] - separators)) << shift | used
        keys.sort()
        pick = keys & ((1 << shift) - 1)
        group = keys >> shift
        apart = (group[1:] == group[:-1]) & (part[pick[1:]] != part[pick[:-1]])
        hits = np.unique(target[at[pick[1:][apart]]])
        start[at] = np.repeat(heads, lasts + 1 - np.flatnonzero(opens))
        end[heads] = at[lasts] + 1
        new = hits[found[hits] == limit]
        found[new] = length + 1
    return found


def own_number(starts: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Small ascending numbers for the parents of the used places."""
    mine = starts[used]
    return np.cumsum(np.concatenate([[0], mine[1:] != mine[:-1]])) if len(mine) else np.zeros(0, np.int64)


def repeated_windows(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of `width` bytes that start more than once in the strings together.

    Returns, over the joined strings with one separator after each, the strings' starts, whether the window at a position is repeated, and
    whether it is the first of its repeats in the order (one of each set of equal windows).
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    m, n = len(strings), int(sizes.sum()) + len(strings)
    symbols = np.empty(n, np.int64)
    body = np.ones(n, bool)
    body[starts + sizes] = False
    symbols[~body] = np.arange(m)
    symbols[body] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + m
    order, ranks = bounded_suffix_order(symbols, width + 1)
    lengths = common_prefixes(order, ranks, symbols, m, width)
    same = lengths >= width
    same[0] = False
    following = np.append(same[1:], False)
    repeated, leader = np.zeros(n, bool), np.zeros(n, bool)
    repeated[order] = same | following
    leader[order] = ~same & following
    return starts, repeated, leader
