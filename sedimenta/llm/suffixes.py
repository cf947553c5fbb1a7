"""Suffix arrays by linear grouping construction."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of an integer text, in linear time after the first bucket sort.

    Phase 1 keeps the suffixes in groups, at first by their first symbol, and works through the groups from the
    highest to the lowest. A suffix of the group at hand points to the nearest one before it in a lower group, its
    previous smaller one; those pointed to are split off upwards from their groups, as often as they are pointed to.
    When a group's turn comes it holds exactly the suffixes of one Lyndon prefix, so no group is renamed or sorted
    again. Phase 2 goes through the suffixes in order and puts, for each, those whose Lyndon prefix ends at it into
    the next free place of their groups, following the same pointers.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(text, kind="stable")
    by = text[order]
    edge = np.concatenate([[True], by[1:] != by[:-1]])
    first = np.flatnonzero(edge)[np.cumsum(edge) - 1]
    sa = order.tolist()
    place, link, size = np.empty(n, np.int64), np.empty(n, np.int64), np.bincount(first, minlength=n + 1).tolist()
    place[order] = np.arange(n)
    link[order] = first
    place, link, prev = place.tolist(), link.tolist(), [-1] * n
    end = n - 1
    while end >= 0:
        low = link[sa[end]]
        if low == end:
            s = sa[end]
            p = s - 1
            while p >= 0 and link[p] >= low:
                p = prev[p]
            prev[s] = p
            moved = [p] if p >= 0 else ()
            times = None
        else:
            times = {}
            for s in sorted(sa[low : end + 1]):
                p = s - 1
                while p >= 0 and link[p] >= low:
                    p = prev[p]
                prev[s] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            moved = list(times)
        round_number = 1
        while moved:
            for p in moved:
                g = link[p]
                k = size[g] - 1
                size[g] = k
                at, last = place[p], g + k
                other = sa[last]
                sa[at], sa[last] = other, p
                place[other], place[p] = at, last
            fresh = [link[p] + size[link[p]] for p in moved]
            for p, g in zip(moved, fresh):
                size[g] += 1
                link[p] = g
            if times is None:
                break
            round_number += 1
            moved = [p for p in moved if times[p] >= round_number]
        end = low - 1
    out, free, done = [0] * n, {}, bytearray(n)
    i, s = -1, n - 1
    while True:
        while s >= 0 and not done[s]:
            g = link[s]
            at = free.get(g, g)
            out[at], free[g], done[s] = s, at + 1, 1
            s = prev[s]
        i += 1
        if i == n:
            return np.array(out, np.int64)
        s = out[i] - 1
