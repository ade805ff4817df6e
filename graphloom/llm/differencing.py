"""Karmarkar-Karp largest differencing for any number of bins."""

from __future__ import annotations

import heapq

import numpy as np


def multiway_difference(sizes: list[int], bins: int) -> list[list[int]]:
    """Split item indexes into ``bins`` lists of near-equal total size.

    Every item starts as a partial partition with one loaded bin.  The two
    partial partitions with the widest imbalance are merged with opposing
    orders (fullest bin onto emptiest) until one partition is left.  Ties go
    to the partition made first, so equal input gives equal output.
    """
    if bins < 1:
        raise ValueError("bins must be positive")
    if not sizes:
        return [[] for _ in range(bins)]
    heap = []
    for i, size in enumerate(sizes):
        loads = np.zeros(bins, dtype=np.int64)
        loads[0] = size
        heap.append((-size, i, loads, [[i]]))
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, left, own = heapq.heappop(heap)
        _, _, right, other = heapq.heappop(heap)
        loads = left + right[::-1]
        members = own + [[] for _ in range(bins - len(own))]
        for j, items in enumerate(other):
            at = bins - 1 - j
            members[at] = members[at] + items
        order = np.argsort(-loads, kind="stable")
        loads = loads[order]
        loads -= loads[-1]
        members = [members[j] for j in order.tolist()]
        while members and not members[-1]:
            members.pop()
        heapq.heappush(heap, (-int(loads[0]), made, loads, members))
        made += 1
    members = heap[0][3]
    return members + [[] for _ in range(bins - len(members))]


def pack_into_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; the count rises until all fit."""
    if any(s > capacity for s in sizes):
        raise ValueError("an item is larger than a window")
    bins = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = multiway_difference(sizes, bins)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return [w for w in windows if w]
        bins += 1
