"""Suffix sorting by linear grouping, without recursion or renaming.

Phase 1 puts suffixes into groups by their longest Lyndon prefix. It starts from groups by first symbol and takes groups in descending
order. Each suffix of the group points to the nearest earlier suffix of a smaller group (its previous-smaller pointer); those that
are pointed to are extended by the group's prefix, so they leave their group for a new one right above it, higher the more
suffixes of the group point to them. Each suffix is taken once.

Phase 2 reads the order from the smallest suffix on. After suffix s, the suffix before it and those on its chain of
previous-smaller pointers come next in their groups.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(symbols: Sequence[int] | np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in ascending order. Any integers serve as symbols; a shorter suffix precedes its extensions."""
    values = np.asarray(symbols, np.int64)
    n = len(values) + 1
    # an end below all symbols makes every suffix differ from every other
    ended = np.append(values, values.min() - 1 if len(values) else 0)
    by_first = np.argsort(ended, kind="stable")
    firsts = ended[by_first]
    bounds = np.flatnonzero(np.concatenate(([True], firsts[1:] != firsts[:-1])))
    sizes = np.diff(np.append(bounds, n))
    order = by_first.tolist()
    where = np.empty(n, np.int64)
    where[by_first] = np.arange(n)
    group_of = np.empty(n, np.int64)
    group_of[by_first] = np.repeat(bounds, sizes)
    place, group = where.tolist(), group_of.tolist()
    size = [0] * n
    for start, k in zip(bounds.tolist(), sizes.tolist(), strict=True):
        size[start] = k
    smaller = [-1] * n
    end = n
    while end:
        this = group[order[end - 1]]
        pointed: dict[int, int] = {}
        # by position, so that earlier members of the group have their pointers already
        for i in sorted(order[this:end]):
            p = i - 1
            while p >= 0:
                g = group[p]
                if g < this:
                    break
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        end = this
        if not pointed:
            continue
        times: dict[int, dict[int, list[int]]] = {}
        for p, k in pointed.items():
            times.setdefault(k, {}).setdefault(group[p], []).append(p)
        for k in sorted(times, reverse=True):
            for old, members in times[k].items():
                top = old + size[old]
                for p in members:
                    top -= 1
                    q, at = order[top], place[p]
                    order[at], place[q] = q, at
                    order[top], place[p] = p, top
                size[old] -= len(members)
                size[top] = len(members)
                for p in members:
                    group[p] = top
    front = list(range(n))
    done = bytearray(n)
    out = [0] * n
    out[0] = n - 1
    done[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[front[g]] = s
            front[g] += 1
            done[s] = 1
            s = smaller[s]
    return np.array(out[1:], np.int64)
