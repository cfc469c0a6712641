"""Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq

import numpy as np


def difference(vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of k bins each slot of each partial partition goes to, and the k sums.

    vectors: (n, w) non-negative integers, w <= k; row i holds the sums of the w slots of partial partition i (an item
    is one with w = 1). The two partitions of largest spread are merged again and again, the
    largest slot of one onto the smallest of the other; no two slots of a row share a bin. Ties: by order.
    Returns (n, w) bins and the sums. Without rows: no bins and zeros.
    """
    n, w = vectors.shape
    if not n:
        return np.zeros((0, w), np.int64), np.zeros(k, np.int64)
    sums: list[np.ndarray | None] = []
    order: list[np.ndarray] = []
    as_is = np.arange(k)
    for row in vectors:
        wide = np.zeros(k, np.int64)
        wide[:w] = row
        by = as_is if w == 1 else np.argsort(-wide, kind="stable")
        sums.append(wide[by])
        order.append(by)
    parts: list[tuple[int, int] | None] = [None] * n
    heap = [(int(s[-1] - s[0]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, x), (_, y) = heapq.heappop(heap), heapq.heappop(heap)
        both = sums[x] + sums[y][::-1]
        by = np.argsort(-both, kind="stable")
        both = both[by]
        sums[x] = sums[y] = None
        sums.append(both)
        order.append(by)
        parts.append((x, y))
        heapq.heappush(heap, (int(both[-1] - both[0]), len(sums) - 1))
    total = sums[-1]
    # place[z][p]: the bin of z's p-th largest slot; undone from the last merge back to the rows.
    place: list[np.ndarray | None] = [None] * len(order)
    place[-1] = np.arange(k)
    bins = np.zeros((n, w), np.int64)
    for z in range(len(order) - 1, -1, -1):
        slot = np.empty(k, np.int64)
        slot[order[z]] = place[z]
        place[z] = None
        if parts[z] is None:
            bins[z] = slot[:w]
        else:
            x, y = parts[z]
            place[x], place[y] = slot, slot[::-1]
    return bins, total
