"""Suffix arrays by linear grouping.

The suffixes are first grouped by their Lyndon prefix, the longest prefix that is smaller than all its own
proper suffixes. Groups are worked off from the highest down. A finished group lengthens the Lyndon prefix of
the suffixes that its members' previous-smaller pointers reach: these move to new groups at the upper end of their
own. With all groups finished, one pass upwards puts each group's suffixes in order, from the order of the
suffixes that follow them. Nothing is renamed, and there is no recursion.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in ascending order. Symbols are whole numbers; the end counts as the lowest."""
    n = len(symbols) + 1
    values, rank = np.unique(symbols, return_inverse=True)
    first = np.r_[0, 1 + np.searchsorted(np.sort(rank), np.arange(len(values)))]
    group = np.r_[first[rank + 1], 0].tolist()  # where the suffix's group starts among all suffixes
    pointer, size = _group(group, n)
    return _order(group, pointer, size, n)[1:]


def _group(group: list[int], n: int) -> tuple[list[int], dict[int, int]]:
    """Bring every suffix into the group of its Lyndon prefix; previous-smaller pointers and group sizes."""
    members: dict[int, list[int]] = {}
    for i, g in enumerate(group):
        if g in members:
            members[g].append(i)
        else:
            members[g] = [i]
    size = {g: len(m) for g, m in members.items()}
    start_below = {g + k: g for g, k in size.items()}  # by the group's upper end
    pointer = [-1] * n
    top = n
    while top > 0:
        g = start_below.pop(top)
        mine = members.pop(g)
        # A suffix that moved away is still listed; sorted, so pointers inside the group are known in time.
        if size[g] != len(mine):
            mine = [i for i in mine if group[i] == g]
        if len(mine) == 1:
            # Alone, it moves no more than one suffix, to the upper end of that one's group.
            i = mine[0]
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = pointer[p]
            pointer[i] = p
            if p >= 0:
                old = group[p]
                k = size[old]
                if k > 1:
                    end = old + k
                    new = end - 1
                    size[old] = k - 1
                    size[new] = 1
                    start_below[end], start_below[new] = new, old
                    members[new] = [p]
                    group[p] = new
            top = g
            continue
        mine.sort()
        reached: dict[int, int] = {}
        for i in mine:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = pointer[p]
            pointer[i] = p
            if p >= 0:
                reached[p] = reached.get(p, 0) + 1
        # What is followed by more members of this group is higher, so it moves first.
        moving: dict[tuple[int, int], list[int]] = {}
        for p, times in reached.items():
            key = (-times, group[p])
            if key in moving:
                moving[key].append(p)
            else:
                moving[key] = [p]
        for _, old in sorted(moving) if len(moving) > 1 else moving:
            rising = moving[_, old]
            k = len(rising)
            if k == size[old]:
                continue
            end = old + size[old]
            new = end - k
            size[old] -= k
            size[new] = k
            start_below[end], start_below[new] = new, old
            members[new] = rising
            for p in rising:
                group[p] = new
        top = g
    return pointer, size


def _order(group: list[int], pointer: list[int], size: dict[int, int], n: int) -> np.ndarray:
    """Fill the groups from their lower ends, following each placed suffix to the ones before it."""
    free = {g: g for g in size}
    out = [-1] * n
    placed = bytearray(n + 1)
    placed[n] = 1  # stands for position -1
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while not placed[j]:
            g = group[j]
            at = free[g]
            free[g] = at + 1
            out[at] = j
            placed[j] = 1
            j = pointer[j]
    return np.array(out, np.int64)


def equal_prefixes(text: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """For each suffix in order whether it shares its first ``width`` bytes with the one before it.

    ``text`` is bytes; suffixes shorter than ``width`` share nothing. ``width`` is at least 8.
    """
    n = len(text)
    same = np.zeros(len(order), bool)
    if n < width:
        return same
    words = np.zeros(n - 7, np.uint64)
    for k in range(8):
        words |= text[k : n - 7 + k].astype(np.uint64) << np.uint64(8 * k)
    at = np.flatnonzero((order[1:] <= n - width) & (order[:-1] <= n - width)) + 1
    for offset in [*range(0, width - 7, 8), width - 8]:
        at = at[words[order[at] + offset] == words[order[at - 1] + offset]]
    same[at] = True
    return same
