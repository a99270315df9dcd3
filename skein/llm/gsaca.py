"""Suffix sorting by Lyndon grouping (linear in the text, without renaming).

After Baier, "Linear-time Suffix Sorting - A New Approach for Suffix Array
Construction" (CPM 2016). Phase 1 groups the suffixes by their Lyndon prefixes:
groups are taken in descending order, and the suffixes that the members' pointers
to their previous smaller suffix hit move up within their groups, by how many
members hit them. Phase 2 goes through the order as it grows and places, for each
suffix placed, the one before it and its chain of previous smaller suffixes at
the next free places of their groups.
"""

from __future__ import annotations

from collections.abc import Sequence


def lyndon_groups(text: Sequence[int]) -> tuple[list[list[int]], list[int], list[int]]:
    """Phase 1: the groups in ascending order, each suffix's group and its pointer."""
    n = len(text)
    members: list[list[int]] = []
    group = [0] * n
    number: dict[int, int] = {}
    for symbol in sorted(set(text)):
        number[symbol] = len(members)
        members.append([])
    for i, symbol in enumerate(text):
        g = number[symbol]
        group[i] = g
        members[g].append(i)
    size = [len(m) for m in members]
    lower = list(range(-1, len(members) - 1))
    upper = [*range(1, len(members)), -1]
    smaller = [-1] * n
    done = bytearray(n)
    g = len(members) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        hits: dict[int, int] = {}
        for i in own:  # ascending, so a member before i has its pointer by now
            done[i] = 1
            j = i - 1
            while j >= 0 and done[j]:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        if hits:
            if len(hits) == 1:
                [(j, _)] = hits.items()
                moves = {(1, group[j]): [j]} if size[group[j]] > 1 else {}
            else:
                moves = {}
                for j, times in hits.items():
                    moves.setdefault((-times, group[j]), []).append(j)
            for (_, old), moved in sorted(moves.items()) if len(moves) > 1 else moves.items():
                if len(moved) == size[old]:
                    continue
                new = len(members)
                moved.sort()
                members.append(moved)
                size.append(len(moved))
                size[old] -= len(moved)
                for j in moved:
                    group[j] = new
                above = upper[old]
                lower.append(old)
                upper.append(above)
                upper[old] = new
                if above >= 0:
                    lower[above] = new
        g = lower[g]
    order, g = [], next((g for g in range(len(members)) if lower[g] < 0), -1)
    while g >= 0:
        order.append(g)
        g = upper[g]
    return [members[g] for g in order], group, smaller


def suffix_array(text: Sequence[int]) -> list[int]:
    """The start positions of all suffixes in ascending order.

    The last symbol must be smaller than all others and occur once.
    """
    groups, _, smaller = lyndon_groups(text)
    n = len(text)
    free = [0] * n  # by suffix: its group's number; then by group: its next free place
    place = [0] * len(groups)
    at = 0
    for number, members in enumerate(groups):
        place[number] = at
        at += len(members)
        for i in members:
            free[i] = number
    order = [-1] * n
    placed = bytearray(n)
    if n:
        order[0] = n - 1
        placed[n - 1] = 1
        place[free[n - 1]] += 1
    for i in order:  # grows while it is read
        j = i - 1
        while j >= 0 and not placed[j]:
            g = free[j]
            order[place[g]] = j
            place[g] += 1
            placed[j] = 1
            j = smaller[j]
    return order
