"""Suffix arrays by grouping (part of operator 1): linear time, without recursion or renaming.

First, suffixes are grouped by their longest Lyndon prefix. Groups are taken in descending order; each member finds, over previous-smaller pointers, the last suffix
before it that is in a lower group, and lengthens that suffix's prefix by its own. Suffixes that are lengthened move to new groups just above their old one,
those lengthened more often higher. A suffix's next smaller suffix then starts where its Lyndon prefix ends. Second, suffixes are emitted in ascending order: as soon as a suffix is placed, all
those whose next smaller suffix it is are next in their groups, and previous-smaller pointers lead to them.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int] | bytes) -> list[int]:
    """The starts of text's suffixes in lexicographic order; a suffix comes before those that it is a prefix of."""
    n = len(text)
    if n == 0:
        return []
    members: list[list[int]] = []
    size: list[int] = []  # of the Lyndon prefix of a group's members
    below: list[int] = []
    above: list[int] = []
    own = [0] * n  # each suffix's group
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    for g, c in enumerate(sorted(by_symbol)):
        members.append(by_symbol[c])
        size.append(1)
        below.append(g - 1)
        above.append(g + 1)
        for i in by_symbol[c]:
            own[i] = g
    pointer = [-2] * n  # -2: not taken yet; else the previous smaller suffix, -1 if none
    order: list[int] = []  # groups, descending
    at = len(members) - 1
    while at >= 0:
        step = size[at]
        current = [i for i in members[at] if own[i] == at]  # ascending, as every group is made
        if current:
            members[at] = current
            order.append(at)
            times: dict[int, int] = {}
            for i in current:
                j = i - 1
                while j >= 0 and pointer[j] != -2:
                    j = pointer[j]
                pointer[i] = j
                if j >= 0:
                    times[j] = times.get(j, 0) + 1
            moved: dict[int, dict[int, list[int]]] = {}  # by how often, then by old group
            for j, k in times.items():
                moved.setdefault(k, {}).setdefault(own[j], []).append(j)
            # from the most often lengthened on, so that each new group goes directly above the old one; all counts together are no more than the members
            for k in range(max(moved, default=0), 0, -1):
                for old, who in moved.get(k, {}).items():
                    new, up = len(members), above[old]
                    members.append(who)
                    size.append(size[old] + k * step)
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    if up < len(below):
                        below[up] = new
                    for j in who:
                        own[j] = new
        at = below[at]
    # second phase: the next free place of each group
    place = [0] * len(members)
    total = 0
    for g in reversed(order):
        place[g] = total
        total += len(members[g])
    out = [0] * n
    ends = n
    taken = 0
    while True:
        i = ends - 1
        while i >= 0:
            g = own[i]
            if i + size[g] != ends:
                break
            out[place[g]] = i
            place[g] += 1
            i = pointer[i]
        if taken == n:
            return out
        ends = out[taken]
        taken += 1

