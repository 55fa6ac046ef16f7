"""Threshold-bounded interval expansion on a Burrows-Wheeler transform.

``common_prefix_groups`` finds which positions of a text start the same string
of ``length`` bytes. The rotations are sorted by their first ``length`` bytes
(a bounded context is all the transform needs here), the transform is read off
that order, and the longest-common-prefix values are derived from it by
breadth-first backward extension: a queue holds intervals of rotations that
start with the same string w; extending w to the left by every byte that
precedes it gives the next intervals, and whenever the rank behind such an
interval has no value yet, its value is the length of w. Lengths come in
increasing order, so the search stops at ``length``: ranks still without a
value share at least that many bytes with their predecessor.

Every level works on whole arrays; no Python loop runs over intervals.
"""

from __future__ import annotations

import numpy as np


def bounded_order(text: np.ndarray, length: int) -> np.ndarray:
    """Start positions of the rotations of ``text``, sorted by their first ``length`` bytes."""
    n, width = len(text), 1
    key = text.astype(np.uint64)
    full = min(8, length)
    while width < full:  # the first bytes of every rotation in one number
        step = min(width, full - width)
        key = (key << np.uint64(8 * step)) | (np.roll(key, -step) & np.uint64((1 << 8 * step) - 1) if step == width else np.roll(text_tail(text, step), -width))
        width += step
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(key[1:], key[:-1], out=fresh[1:])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=np.int32), 0))
    while width < length:
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        tied = np.flatnonzero(~alone).astype(np.int32)
        if not len(tied):
            break
        step = min(width, length - width)
        at = order[tied]
        behind = at + np.int32(step)
        behind[behind >= n] %= n
        pair = (rank[at].astype(np.uint64) << np.uint64(32)) | rank[behind].astype(np.uint64)
        by = np.argsort(pair)
        at, pair = at[by], pair[by]
        order[tied] = at
        new = np.empty(len(tied), bool)
        new[0] = True
        np.not_equal(pair[1:], pair[:-1], out=new[1:])
        fresh[tied] = new
        rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        width += step
    return order


def text_tail(text: np.ndarray, step: int) -> np.ndarray:
    """The first ``step`` bytes of every rotation as a number."""
    out = np.zeros(len(text), np.uint64)
    for i in range(step):
        out = (out << np.uint64(8)) | np.roll(text, -i).astype(np.uint64)
    return out


def bounded_lcp(bwt: np.ndarray, length: int) -> np.ndarray:
    """Common-prefix length of each rank with the one before, below ``length``; -1 where it is ``length`` or more."""
    n = len(bwt)
    first = np.argsort(bwt, kind="stable").astype(np.int32)  # rank of the extended rotation -> rank of its tail
    extended = np.empty(n, np.int32)
    extended[first] = np.arange(n, dtype=np.int32)
    same = bwt[first[1:]] == bwt[first[:-1]]
    after, before = np.full(n, n, np.int32), np.full(n, -1, np.int32)  # rows with the same byte next to each row
    after[first[:-1][same]] = first[1:][same]
    before[first[1:][same]] = first[:-1][same]
    lcp = np.full(n + 1, -1, np.int16)
    lcp[0] = lcp[n] = 0
    lo, hi = np.zeros(1, np.int32), np.full(1, n - 1, np.int32)
    for level in range(length):
        size = hi - lo + 1
        ends = np.cumsum(size, dtype=np.int32)
        at = np.arange(ends[-1], dtype=np.int32) + np.repeat(lo - (ends - size), size)  # all rows of the intervals
        right = np.sort(extended[at[after[at] > np.repeat(hi, size)]])  # of each byte in an interval, the last row
        left = np.sort(extended[at[before[at] < np.repeat(lo, size)]])  # and the first: the ends of the extended interval
        new = lcp[right + 1] == -1
        lcp[right[new] + 1] = level
        if level:
            right, left = right[new], left[new]
        lo, hi = left, right
        if not len(lo):
            break
    return lcp[:n]


def common_prefix_groups(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): sorted positions, and where in them each group of equal ``length``-byte strings starts."""
    order = bounded_order(text, length)
    bwt = text[order - 1]
    return order, np.flatnonzero(bounded_lcp(bwt, length) >= 0)
