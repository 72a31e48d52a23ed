"""Suffix arrays of many short texts at once, by linear grouping.

Phase 1 groups the suffixes of a text by their Lyndon prefix.  All suffixes that start with one
byte are a group at first; groups are processed in descending order.  Each member of the
group finds its previous-smaller pointer (the nearest suffix to the left in a lower group);
the suffixes pointed at leave their group for a new one directly above it, those pointed at
more often further up.  Phase 2 fills the suffix array from the left: the suffix before a
placed one, and then the chain of its pointers, take the next places of their groups.  No
names are sorted recursively.

numpy runs the texts ("lanes") side by side: round r processes the r-th group from the top of
every lane.  The work is linear in all texts, the number of rounds that of the longest lane, so
lanes of similar length belong together.
"""

from __future__ import annotations

import numpy as np


def ragged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices starts[k] .. starts[k] + sizes[k] - 1 for all k, and the k of each."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(of)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes), of


def group_suffixes(text: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1.  text: all lanes one after the other (below 2**31 bytes); first, length: of each lane.

    Returns (group, previous): the slot at which a suffix's group starts, and its pointer (-1:
    none).  Suffixes and slots are counted over all lanes.
    """
    n = len(text)
    lane = np.repeat(np.arange(len(length)), length)
    begin = first[lane].astype(np.int32)
    slots = np.argsort(lane << 8 | text, kind="stable").astype(np.int32)  # by lane, then byte
    place = np.empty(n, np.int32)
    place[slots] = np.arange(n, dtype=np.int32)
    key = (lane << 8 | text)[slots]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    heads = new.nonzero()[0].astype(np.int32)
    size = np.zeros(n, np.int32)  # of the group that starts at a slot
    size[heads] = np.diff(np.append(heads, n))
    group = np.empty(n, np.int32)
    group[slots] = np.repeat(heads, size[heads])
    previous = np.full(n, -1, np.int32)
    is_parent = np.zeros(n, bool)
    top = (first + length - 1)[length > 0]  # the highest slot not yet processed, by lane
    floor = first[length > 0]
    while len(top):
        start = group[slots[top]]
        at, _ = ragged(start, size[start])
        members = slots[at]
        own, low = group[members], begin[members]
        p = members - 1
        p[p < low] = -1
        search = (p >= 0).nonzero()[0]
        while len(search):
            here, limit = p[search], own[search]
            g = group[here]
            up = (g >= limit).nonzero()[0]
            search, here, g, limit = search[up], here[up], g[up], limit[up]
            # higher groups have their pointers; within this group one step to the left will do
            q = np.where(g > limit, previous[here], np.where(here > low[search], here - 1, -1))
            p[search] = q
            search = search[q >= 0]
        previous[members] = p
        some = np.sort(p[p >= 0])
        if len(some):
            edge = np.ones(len(some), bool)
            edge[1:] = some[1:] != some[:-1]
            at = edge.nonzero()[0]
            parents, times = some[at], np.diff(np.append(at, len(some)))
            home = group[parents]
            order = np.argsort(home.astype(np.int64) << 32 | times)
            parents, home, times = parents[order], home[order], times[order]
            edge = np.ones(len(parents), bool)
            edge[1:] = home[1:] != home[:-1]
            heads = edge.nonzero()[0]
            homes, count = home[heads], np.diff(np.append(heads, len(parents)))
            new_from = homes + size[homes] - count  # the last slots of the group become theirs
            target, _ = ragged(new_from, count)
            taken = place[parents]
            free = taken[taken < np.repeat(new_from, count)]  # of parents from below their new slots
            held = slots[target]
            is_parent[parents] = True
            moved = held[~is_parent[held]]
            is_parent[parents] = False
            # both are in order of group, and a group has as many of one as of the other
            slots[free] = moved
            place[moved] = free
            slots[target] = parents
            place[parents] = target
            run = edge
            run[1:] |= times[1:] != times[:-1]
            runs = run.nonzero()[0]
            width = np.diff(np.append(runs, len(parents)))
            size[homes] -= count
            size[target[runs]] = width
            group[parents] = np.repeat(target[runs], width)
        top = start - 1
        going = top >= floor
        top, floor = top[going], floor[going]
    return group, previous


def suffix_arrays(text: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Suffixes of all lanes, sorted within each lane (a lane's end is smaller than any byte)."""
    group, previous = group_suffixes(text, first, length)
    n = len(text)
    out = np.zeros(n + 1, np.int32)
    placed = np.zeros(n, bool)
    following = np.arange(n, dtype=np.int32)  # next free slot of the group that starts here
    lanes = length > 0
    low, stop = first[lanes].astype(np.int32), (first + length)[lanes].astype(np.int32)
    j = stop - 1  # the suffix before the end of the lane comes first
    i = low.copy()  # the slot whose predecessor is next
    while len(j):
        # a round: lanes whose chain has ended go on with the next slot, then one suffix is placed
        ended = ((j < low) | placed[j]).nonzero()[0]
        if len(ended):
            at = i[ended]
            j[ended] = np.where(at < stop[ended], out[at] - 1, -1)
            i[ended] = at + 1
        go = ((j >= low) & ~placed[j]).nonzero()[0]
        put = j[go]
        g = group[put]
        slot = following[g]
        out[slot] = put
        following[g] = slot + 1
        placed[put] = True
        j[go] = previous[put]
        if len(go) < len(j):
            alive = (i <= stop).nonzero()[0]
            if len(alive) < len(j):
                i, j, low, stop = i[alive], j[alive], low[alive], stop[alive]
    return out[:n]
