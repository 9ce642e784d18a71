"""Order of all suffixes of many short texts by linear grouping.

The Lyndon prefix of a suffix ends where the next smaller suffix begins. First suffixes are grouped by their Lyndon prefix, in
descending order: those of the highest first byte come first, and each finished group is handed to the previous smaller
suffixes of its members, which it splits, as the Lyndon prefix of such a suffix goes on with theirs. A group is told by the
number of suffixes in groups below it, so a split moves no other group and nothing is renamed. Suffixes that follow each other with the
same first byte form chains; of these the next smaller one is found from the end of the chain. Then, in ascending order, the suffixes of
a group are put in the order of what follows their Lyndon prefix, a smaller suffix and so already in order. Nothing is sorted again
for longer prefixes. All texts are worked through at once, array by array; the end of a text is below every byte.
"""

from __future__ import annotations

import numpy as np


class _Groups:
    """Suffixes of one first byte in groups; id: how many of them stand in lower groups."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = ids
        self.size = np.bincount(ids, minlength=len(ids))

    def open(self, some: np.ndarray) -> np.ndarray:
        """Which of some are not alone in their group."""
        return self.size[self.ids[some]] > 1

    def split(self, some: np.ndarray, keys: np.ndarray) -> None:
        """Members named move behind the others of their group, in the order of their keys."""
        if not len(some):
            return
        both = (self.ids[some] << 32) | keys
        order = np.argsort(both)
        both, some = both[order], some[order]
        old, at = both >> 32, np.arange(len(both))
        new, first = np.ones(len(both), bool), np.ones(len(both), bool)
        new[1:], first[1:] = both[1:] != both[:-1], old[1:] != old[:-1]
        group = np.flatnonzero(first)
        moved = np.diff(np.append(group, len(both)))
        stay = self.size[old[group]] - moved
        ids = old + np.repeat(stay, moved) + np.maximum.accumulate(np.where(new, at, 0)) - np.repeat(group, moved)
        self.ids[some] = ids
        begin = np.flatnonzero(new)
        self.size[old[group]] = stay
        self.size[ids[begin]] = np.diff(np.append(begin, len(both)))


def _chain_ends(link: np.ndarray) -> np.ndarray:
    """For each member, the place behind the last one of its chain."""
    stops = np.flatnonzero(np.append(~link, True))
    return stops[np.searchsorted(stops, np.arange(len(link) + 1))] + 1


def _next_smaller(m: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each member of a chain of groups m, where the next smaller suffix of the chain begins, or the chain's end."""
    here = np.arange(len(m))
    stop, left = here + 1, last - 1 - here
    order = np.argsort(left, kind="stable")
    bounds = np.searchsorted(left[order], np.arange(int(left.max(initial=0)) + 2))
    for t in range(1, len(bounds) - 1):
        now = order[bounds[t] : bounds[t + 1]]
        while len(now):
            greater = np.zeros(len(now), bool)
            some, a, b, end = np.arange(len(now)), stop[now], now.copy(), last[now]
            while len(some):
                x, y = m[a], m[b]
                greater[some[x > y]] = True
                same = (x == y) & (a + 1 < end)
                some, a, b, end = some[same], a[same] + 1, b[same] + 1, end[same]
            now = now[greater]
            stop[now] = stop[stop[now]]
            now = now[stop[now] < last[now]]
    return stop


def suffix_ranks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte of texts data[offsets[k]:offsets[k + 1]], how many suffixes of texts are smaller than the one that starts there."""
    n = len(data)
    end = np.repeat(offsets[1:].astype(np.int32), np.diff(offsets))
    order = np.argsort(data, kind="stable")
    base = np.concatenate([[0], np.cumsum(np.bincount(data, minlength=256))])
    group, length, rank = np.zeros(n, np.int32), np.ones(n, np.int32), np.zeros(n, np.int32)
    present = np.flatnonzero(np.diff(base))

    for c in present[::-1].tolist():
        at = order[base[c] : base[c + 1]]
        ends, follow, groups = end[at], at + 1, _Groups(np.zeros(len(at), np.int64))
        some = np.arange(len(at))
        while len(some):
            some = some[follow[some] < ends[some]]
            some = some[data[follow[some]] > c]
            child = follow[some]
            open_ = groups.open(some)
            groups.split(some[open_], group[child[open_]])
            follow[some] = child + length[child]
        link = (follow[:-1] == at[1:]) & (follow[:-1] < ends[:-1])
        if link.any():
            m = groups.ids.copy()
            stop = _next_smaller(m, _chain_ends(link))
            many = stop - np.arange(len(at))
            some, x = np.flatnonzero(many > 1), 1
            while len(some):
                some = some[groups.open(some)]
                groups.split(some, m[some + x])
                x += 1
                some = some[many[some] > x]
            follow = follow[stop - 1]
        length[at] = follow - at
        group[at] = base[c] + groups.ids

    for c in present.tolist():
        at = order[base[c] : base[c + 1]]
        follow = at + length[at]
        over = follow >= end[at]
        inside = ~over
        inside[inside] = data[follow[inside]] == c
        own = group[at] - base[c]
        key = np.zeros(len(at), np.int64)
        below = ~over & ~inside
        key[below] = rank[follow[below]] + 1
        after = np.zeros(len(at), np.int64)
        after[inside] = np.searchsorted(at, follow[inside])
        key[inside] = n + 2 + own[after[inside]]
        groups = _Groups(own.astype(np.int64))
        some = np.flatnonzero(groups.open(np.arange(len(at))))
        there = some
        while len(some):
            groups.split(some, key[there])
            more = inside[there]
            some, there = some[more], after[there[more]]
            open_ = groups.open(some)
            some, there = some[open_], there[open_]
        rank[at] = base[c] + groups.ids
    return rank
