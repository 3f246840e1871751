"""Suffix order of many short texts by linear grouping: Lyndon-prefix groups, then each group's order without renaming.

The longest Lyndon prefix of a suffix ends where the next smaller suffix begins. Phase one finds these ends for all texts in step,
from the right, by pointer jumping over smaller suffixes, and puts suffixes of one Lyndon prefix into one group; groups are in the
order of their prefixes, and every suffix of a group stands before those of the next. Phase two emits a group's order once the
suffixes that follow its members' prefixes have their final places: these stand in lower groups (or repeat the prefix), so a
member's place is its group's start plus its order by (number of repeats, place of what follows). No rank is computed twice.
All groups whose followers are placed are emitted together.
"""

from __future__ import annotations

import numpy as np


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def suffix_order(texts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, keys): suffixes of all rows in ascending order, a shorter one before its extensions; ties by (row).

    texts: rows of bytes >= 1, zero beyond `size`. keys[c, row]: the eight bytes at column c as one big-endian integer.
    """
    rows, wide = texts.shape
    pad = np.zeros((rows, wide + 24), np.uint8)
    pad[:, :wide] = texts
    keys = np.ascontiguousarray(np.ndarray((rows, wide + 16), ">u8", pad, strides=(wide + 24, 1)).astype(np.uint64).T)
    nxt = np.zeros((wide + 1, rows), np.int16)
    for c in range(wide - 1, -1, -1):
        who = np.flatnonzero(size > c)
        at = np.full(len(who), c + 1, np.int64)
        while len(who):
            a, b = keys[c, who], keys[at, who]
            tie, t = np.flatnonzero(a == b), 8
            while len(tie):
                a[tie], b[tie] = keys[min(c + t, wide + 15), who[tie]], keys[np.minimum(at[tie] + t, wide + 15), who[tie]]
                tie, t = tie[(a[tie] == b[tie]) & (a[tie] != 0)], t + 8
            down = b < a
            nxt[c, who[down]] = at[down]
            who, at = who[~down], at[~down]
            at = nxt[at, who].astype(np.int64)
    col, row = np.nonzero(np.arange(wide)[:, None] < size[None])
    n = len(col)
    place = np.full((wide + 1, rows), n, np.int32)  # of a suffix in the lists; n: the empty one
    place[col, row] = np.arange(n, dtype=np.int32)
    ends = nxt[col, row].astype(np.int64)
    length = ends - col
    # groups: start (rank of the first member) by eight bytes of the prefix at a time
    group = np.zeros(n, np.int64)
    todo, t = np.arange(n), 0
    while len(todo):
        left = np.clip(length[todo] - t, 0, 8)
        mask = np.where(left == 0, np.uint64(0), ~np.uint64(0) << (np.uint64(8) * (8 - np.maximum(left, 1)).astype(np.uint64)))
        part = keys[np.minimum(col[todo] + t, wide + 15), row[todo]] & mask
        order = np.lexsort((part, group[todo])) if t else np.argsort(part)
        todo, part = todo[order], part[order]
        old = group[todo]
        head = np.concatenate([[True], old[1:] != old[:-1]])
        new = head | np.concatenate([[True], part[1:] != part[:-1]])
        first = np.maximum.accumulate(np.where(head, np.arange(len(todo)), 0))
        begin = np.maximum.accumulate(np.where(new, np.arange(len(todo)), 0))
        group[todo] = old + begin - first
        t += 8
        more = np.add.reduceat((length[todo] > t).astype(np.int64), np.flatnonzero(new)) > 0
        todo = todo[np.repeat(more, np.diff(np.append(np.flatnonzero(new), len(todo))))]
    # what follows the repeats of the prefix, and how many repeats there are
    follow, repeats = place[ends, row], np.ones(n, np.int64)
    for c in range(wide - 2, -1, -1):
        i = place[c]
        i = i[i < n]
        j = follow[i]
        same = np.flatnonzero(j < n)
        same = same[group[i[same]] == group[j[same]]]
        repeats[i[same]] = repeats[j[same]] + 1
        follow[i[same]] = follow[j[same]]
    # emission
    members = np.argsort(group.astype(np.int32))
    starts = np.flatnonzero(np.concatenate([[True], np.diff(group[members]) > 0]))
    sizes = np.diff(np.append(starts, n))
    number = np.empty(n, np.int64)
    number[members] = np.repeat(np.arange(len(starts)), sizes)
    waits = np.where(follow < n, number[np.minimum(follow, n - 1)], len(starts))
    by_wait = np.argsort(waits.astype(np.int32))
    wait_head = np.concatenate([[0], np.cumsum(np.bincount(waits, minlength=len(starts) + 1))])
    missing = np.bincount(number[waits < len(starts)], minlength=len(starts))
    rank = np.full(n + 1, 0, np.int64)
    ready = np.flatnonzero(missing == 0)
    final = np.zeros(n, np.int64)
    bits, more = max(1, int(n + 1).bit_length()), max(1, int(wide).bit_length())
    while len(ready):
        own = members[_ranges(starts[ready], sizes[ready])]
        key = (group[own] << (bits + more)) | (repeats[own] << bits) | rank[follow[own]]
        own = own[np.argsort(key)]
        spot = _ranges(starts[np.sort(ready)], sizes[np.sort(ready)])
        final[spot] = own
        rank[own] = spot + 1
        freed = number[by_wait[_ranges(wait_head[ready], wait_head[ready + 1] - wait_head[ready])]]
        if not len(freed):
            break
        np.subtract.at(missing, freed, 1)
        ready = np.unique(freed)
        ready = ready[missing[ready] == 0]
    return row[final], col[final], keys


def window_minima(buf: np.ndarray, off: np.ndarray, owner: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """For each text (buf[off[i]:off[i+1]], bytes) and each of its windows of `depth` bytes, the least owner of a text in which the
    window occurs. Rows: texts; columns: window starts; unused cells hold the largest integer. group is not needed: all texts are sorted."""
    size = np.diff(off)
    rows = len(size)
    out = np.full((rows, max(1, int(size.max(initial=0)) - depth + 1)), np.iinfo(np.int64).max)
    if not rows or size.max() < depth:
        return out
    pad = np.zeros((rows, int(size.max())), np.uint8)
    pad[np.repeat(np.arange(rows), size), np.arange(off[-1] - off[0]) - np.repeat(off[:-1] - off[0], size)] = buf[off[0] : off[-1]] + 1
    row, col, keys = suffix_order(pad, size)
    whole = size[row] - col >= depth
    row, col = row[whole], col[whole]
    new = np.ones(len(row), bool)
    same = np.ones(len(row) - 1, bool)
    for t in range(0, depth, 8):
        shift = np.uint64(8 * max(0, 8 - (depth - t)))
        k = keys[col + t, row] >> shift
        same &= k[1:] == k[:-1]
    new[1:] = ~same
    least = np.minimum.reduceat(owner[row], np.flatnonzero(new))
    out[row, col] = least[np.cumsum(new) - 1]
    return out
