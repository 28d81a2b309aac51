"""Linear-time suffix sorting by grouping (Baier, 2016), without recursive renaming.

First the suffixes are grouped by their Lyndon prefixes: groups are taken from the highest
to the lowest; the previous suffix of a smaller group of each member moves, together with others
reached as often, into a new group right above its old one. Then the order within the
groups is read off in one pass from the smallest suffix on.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions in ascending order of their suffixes; the end of the text sorts before every symbol."""
    n = len(text)
    if not n:
        return []
    where: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        where.setdefault(c, []).append(i)
    # A group is named by its first place in the suffix array, so names compare as groups do.
    group, members = [0] * n, {}
    size, first_of_end = [0] * n, [0] * (n + 1)
    at = 0
    for c in sorted(where):
        own = where[c]
        members[at] = own
        size[at] = len(own)
        first_of_end[at + len(own)] = at
        for i in own:
            group[i] = at
        at += len(own)
    smaller = [-1] * n
    end = n
    while end:
        g = first_of_end[end]
        own = members.pop(g)
        if len(own) != end - g:
            own = [i for i in own if group[i] == g]  # the others have moved up
        reached: dict[int, int] = {}
        for i in own:  # in ascending order, so pointers of the same group are there
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                reached[p] = reached.get(p, 0) + 1
        if reached:
            if (top := max(reached.values())) == 1:
                levels = [list(reached)]
            else:
                by: dict[int, list[int]] = {}
                for p, times in reached.items():
                    by.setdefault(times, []).append(p)
                levels = [by[t] for t in range(top, 0, -1) if t in by]
            for level in levels:  # the most often reached first: they stay above the rest
                parts: dict[int, list[int]] = {}
                for p in level:
                    parts.setdefault(group[p], []).append(p)
                for old, moved in parts.items():
                    left = size[old] - len(moved)
                    if left:
                        new = old + left
                        first_of_end[old + size[old]] = new
                        first_of_end[new] = old
                        size[old], size[new] = left, len(moved)
                        members[new] = moved
                        for p in moved:
                            group[p] = new
        end = g
    order = [-1] * n
    placed = bytearray(n)
    head = list(range(n))
    s, i = n - 1, 0
    while True:
        while s >= 0 and not placed[s]:
            g = group[s]
            order[head[g]] = s
            head[g] += 1
            placed[s] = 1
            s = smaller[s]
        if i == n:
            return order
        s = order[i] - 1
        i += 1
