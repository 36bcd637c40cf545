"""Suffix order in linear time by Lyndon groups (Baier's construction)."""

from __future__ import annotations


def suffix_order(symbols: list[int]) -> list[int]:
    """Starts of all suffixes in ascending order. The last symbol must be smaller than all others.

    First the suffixes are grouped by their longest Lyndon prefix. Groups are taken from the
    greatest down: each suffix of the group finds the nearest one before it in a smaller group,
    whose prefix the group's own prefix prolongs; the suffixes found leave their groups for new
    ones just above, those found more often higher up. Then the order within the groups is read
    off: each suffix, in order, hands the next places of their groups to the suffixes whose
    Lyndon prefix ends where it starts.
    """
    n = len(symbols)
    counts: dict[int, int] = {}
    for c in symbols:
        counts[c] = counts.get(c, 0) + 1
    start, at = {}, 0
    for c in sorted(counts):
        start[c] = at
        at += counts[c]
    group = [start[c] for c in symbols]  # named by its first place in the order
    size = [0] * n
    members: list = [None] * n
    for c, g in start.items():
        size[g] = counts[c]
        members[g] = []
    for i, g in enumerate(group):
        members[g].append(i)
    before = [-1] * n
    for g in range(n - 1, 0, -1):
        own = members[g]
        if own is None:
            continue
        members[g] = None
        if len(own) == 1:
            i = own[0]
            if group[i] != g:
                continue
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0:
                h = group[j]
                left = size[h] - 1
                if left:
                    size[h] = left
                    group[j] = left = h + left
                    size[left] = 1
                    members[left] = [j]
            continue
        found: dict[int, int] = {}
        for i in own:
            if group[i] == g:
                j = i - 1
                while j >= 0 and group[j] >= g:
                    j = before[j]
                before[i] = j
                if j >= 0:
                    found[j] = found.get(j, 0) + 1
        if not found:
            continue
        levels: dict[int, dict[int, list[int]]] = {}
        for j, times in found.items():
            levels.setdefault(times, {}).setdefault(group[j], []).append(j)
        for times in sorted(levels, reverse=True):
            for h, moved in levels[times].items():
                left = size[h] - len(moved)
                if left:
                    size[h] = left
                    above = h + left
                    size[above] = len(moved)
                    members[above] = moved
                    for j in moved:
                        group[j] = above
    order = [0] * n
    order[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    free = list(range(n))
    for r in range(n):
        j = order[r] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = before[j]
    return order
