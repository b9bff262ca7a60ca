"""Suffix arrays by linear grouping, for many short texts in step with each other.

First phase: suffixes start in groups by their first symbol. Groups are taken in descending order; each member finds, by previous-smaller pointers,
the last suffix before it in a smaller group, and those suffixes are moved up inside their groups by how many members point at
them. At the end every group holds the suffixes with one Lyndon prefix, in order. Second phase: the suffixes are emitted in order;
each places the one before it, and that one's chain of pointers, at the front of their groups. Nothing is renamed or recursed on.

Each text is a lane. A step takes the next group of every lane that has one left, so that the steps are as many as the longest text has groups and
each is a handful of array operations. A pointer that a walk has followed lies hidden behind the walk's start from then on, so all walks of
a text together are as long as the text; buckets are filled by radix sorts of 16-bit symbols.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def _radix(values: np.ndarray) -> np.ndarray:
    """A stable order of small numbers, by 16 bits at a time."""
    order = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    if len(values) and int(values.max()) >> 16:
        order = order[np.argsort((values[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def _groups(symbols: np.ndarray, lane: np.ndarray) -> tuple[np.ndarray, ...]:
    """First phase: for each suffix (by its place in the lanes' joined symbols) its group, named by the group's first rank, and its pointer."""
    n = len(symbols)
    order = _radix(symbols)
    order = order[_radix(lane[order])]
    edge = np.ones(n, bool)
    edge[1:] = (symbols[order[1:]] != symbols[order[:-1]]) | (lane[order[1:]] != lane[order[:-1]])
    first = np.flatnonzero(edge)
    size, group, place = np.zeros(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
    size[first] = np.diff(np.append(first, n))
    group[order] = np.repeat(first, size[first])
    place[order] = np.arange(n)
    prev, moved = np.full(n, -1), np.zeros(n, bool)
    low = np.flatnonzero(np.append(True, lane[1:] != lane[:-1]))
    end = np.append(low[1:], n)
    while len(low):
        top = group[order[end - 1]]
        count = end - top
        if len(top) == int(count.sum()):
            members, tops, lows = order[top], top, low
        else:
            at = np.repeat(top - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            members, tops, lows = np.sort(order[at]), np.repeat(top, count), np.repeat(low, count)
        p = members - 1
        walk = np.flatnonzero(p >= lows)
        p[p < lows] = -1
        while len(walk):
            walk = walk[group[p[walk]] > tops[walk]]
            p[walk] = prev[p[walk]]
            walk = walk[p[walk] >= 0]
        same = (p >= 0) & (group[p] == tops)
        if same.any():  # stopped at the member before: its pointer holds here too
            p = p[np.maximum.accumulate(np.where(same, 0, np.arange(len(p))))]
        prev[members] = p
        end = top
        go = end > low
        if not go.all():
            low, end = low[go], end[go]
        target, hits = np.unique(p[p >= 0], return_counts=True)
        large = size[group[target]] > 1
        target, hits = target[large], hits[large]
        if not len(target):
            continue
        own = np.lexsort((hits, group[target]))
        target, hits = target[own], hits[own]
        g = group[target]
        start = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        k = np.diff(np.append(start, len(g)))
        full = k == size[g[start]]
        if full.any():  # the lowest stay the group itself
            keep = ~(np.repeat(full, k) & (hits == np.repeat(hits[start], k)))
            target, hits, g = target[keep], hits[keep], g[keep]
            if not len(target):
                continue
            start = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            k = np.diff(np.append(start, len(g)))
        bottom = np.repeat(g[start] + size[g[start]] - k, k)  # the moved take the top k ranks of their group
        to = bottom + np.arange(len(g)) - np.repeat(start, k)
        moved[target] = True
        there, here = order[to], place[target]
        there, here = there[~moved[there]], here[here < bottom]
        order[here], place[there] = there, here
        order[to], place[target] = target, to
        moved[target] = False
        size[g[start]] -= k
        run = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (hits[1:] != hits[:-1])))
        width = np.diff(np.append(run, len(g)))
        group[target] = np.repeat(to[run], width)
        size[to[run]] = width
    return group, prev


def suffix_arrays(symbols: np.ndarray, lane: np.ndarray) -> np.ndarray:
    """The places of all suffixes, lane by lane in lexicographic order.

    symbols: small numbers; each lane ends in a 0, which stands nowhere else in it. lane: ascending numbers of the lanes.
    """
    if not len(symbols):
        return np.empty(0, np.int64)
    group, prev = _groups(symbols, lane)
    n = len(symbols)
    low = np.flatnonzero(np.append(True, lane[1:] != lane[:-1]))
    high = np.append(low[1:], n)
    out, free, done = np.empty(n, np.int64), np.arange(n), np.zeros(n, bool)
    out[low] = high - 1
    done[high - 1] = True
    free[group[high - 1]] += 1
    at, s = low.copy(), high - 2
    while len(at):
        place = s >= low
        place[place] = ~done[s[place]]
        if place.all():
            own = s
        else:
            own = s[place]
        g = group[own]
        out[free[g]] = own
        free[g] += 1
        done[own] = True
        s[place] = prev[own]
        rest = s >= low
        rest[rest] = ~done[s[rest]]
        step = ~rest
        at[step] += 1
        over = at >= high
        if over.any():
            go = ~over
            low, high, at, s, step = low[go], high[go], at[go], s[go], step[go]
        s[step] = out[at[step]] - 1
    return out


def suffix_array(text: Sequence[int]) -> list[int]:
    """The starts of the suffixes of one sequence of symbols below 65535 in lexicographic order; a shorter suffix comes before its extensions."""
    if not len(text):
        return []
    symbols = np.append(np.asarray(text, np.int64) + 1, 0)
    return suffix_arrays(symbols, np.zeros(len(symbols), np.int64))[1:].tolist()
