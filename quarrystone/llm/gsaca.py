"""Suffix sorting by linear grouping.

First all suffixes are put into groups by the Lyndon word they begin with.
Groups are taken from the highest down: each suffix of a group points to the
nearest suffix before it in a lower group (its previous smaller one), and what
is pointed at moves to a new group just above its own, higher for more
pointers, as its Lyndon word grows by that of the group. Then the groups emit
their order: going through the suffix array from its start, each suffix places
the one before it, and those along the previous-smaller pointers, at the front
of what is left of their groups. Nothing is renamed or sorted recursively;
both passes are linear.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: bytes) -> np.ndarray:
    """Start positions of all suffixes of ``text`` in lexicographic order."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    # Groups by first byte; a group is a number, its members a list that may hold suffixes that have moved on.
    by_byte = np.argsort(np.frombuffer(text, np.uint8), kind="stable")
    used, starts = np.unique(np.frombuffer(text, np.uint8)[by_byte], return_index=True)
    members = [part.tolist() for part in np.split(by_byte, starts[1:])]
    group = [0] * n
    for g, part in enumerate(members):
        for s in part:
            group[s] = g
    below = list(range(-1, len(used) - 1))  # the next lower group
    above = [*range(1, len(used)), -1]
    prev = [-1] * n
    order: list[list[int]] = []  # the groups as they are done, the highest first
    g = len(used) - 1
    done = bytearray(n)
    while g >= 0:
        own = [s for s in members[g] if group[s] == g]
        members[g] = own
        if own:
            order.append(own)
            pointed: dict[int, int] = {}
            for s in own:
                done[s] = 1
            for s in own:
                p = s - 1
                while p >= 0 and done[p]:  # of this group or a higher one: skip to what it points at
                    p = prev[p]
                prev[s] = p
                if p >= 0:
                    pointed[p] = pointed.get(p, 0) + 1
            if pointed:
                times = set(pointed.values())
                levels = (pointed,) if len(times) == 1 else [[p for p, k in pointed.items() if k == t] for t in sorted(times, reverse=True)]
                for moved in levels:
                    to: dict[int, int] = {}
                    for p in moved:
                        old = group[p]
                        new = to.get(old)
                        if new is None:
                            new = to[old] = len(members)
                            members.append([])
                            up = above[old]
                            above.append(up)
                            below.append(old)
                            above[old] = new
                            if up >= 0:
                                below[up] = new
                        group[p] = new
                        members[new].append(p)
        g = below[g]
    # Slots of each suffix's group, ascending.
    sa = [-1] * n
    head = [0] * len(members)
    at = 0
    for own in reversed(order):
        head[group[own[0]]] = at
        at += len(own)
    placed = bytearray(n)

    for i in range(-1, n):  # -1: what the empty suffix places
        e = (sa[i] if i >= 0 else n) - 1
        while e >= 0 and not placed[e]:
            gid = group[e]
            sa[head[gid]] = e
            head[gid] += 1
            placed[e] = 1
            e = prev[e]
    return np.array(sa)
