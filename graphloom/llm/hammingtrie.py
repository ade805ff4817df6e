"""Self-join of 64-bit fingerprints on a binary trie of their bits.

A trie node is a range of a sorted array: all values with the same leading
bits.  Pairs of nodes are traversed together, level by level, each with the
number of leading bits in which its two nodes differ.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SEGMENTS = 5
BATCH_PAIRS = 1 << 18


@dataclass(frozen=True)
class Shape:
    """How values are read: a ring of five segments in the leading ``width`` bits, then bits with a budget of their own.

    ``root`` is the least length of a segment, ``segment`` the greatest;
    ``slack`` is what the bits beyond ``width`` may differ in.
    """

    segment: int
    root: int
    width: int = 64
    slack: int = 0


WHOLE = Shape(13, 12)
WINDOW = Shape(8, 8, 40, 12)


def prefix_budgets(errors: int, shape: Shape = WHOLE) -> np.ndarray:
    """Most differing bits allowed among the first ``d`` bits, for d = 0 to 64.

    If two rings differ in at most ``errors`` <= 4 bits then, from one of the
    segments on, the first k segments hold at most ``errors * k / 5`` of them
    for every k; the first holds none.  A shorter segment moves with the
    start, so a level belongs to the later of the segments that it may be in.
    """
    depth = np.arange(65)
    segment = np.minimum(SEGMENTS, (depth + shape.segment - shape.root - 1) // shape.segment + (depth > 0))
    return errors * segment // SEGMENTS + shape.slack * (depth > shape.width)


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the pairs ``a, b`` in ``label`` (each index's least known member)."""
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        least = np.minimum(la, lb)
        np.minimum.at(label, la, least)
        np.minimum.at(label, lb, least)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def forest(
    values: np.ndarray,
    starts: np.ndarray,
    errors: int = 4,
    shape: Shape = WHOLE,
    split: np.ndarray | None = None,
    cross: np.ndarray | None = None,
    marks: np.ndarray | None = None,
    most: int = 64,
) -> np.ndarray:
    """Least linked member of each value's component.

    ``values`` are unsigned 64-bit, sorted within each block; ``starts`` has
    the blocks' first indexes and the end.  Values of a block share their first
    ``shape.root`` bits; blocks are not compared.  A block may be a cell of a
    block that was split ``split`` bits deeper: with ``cross`` it holds the
    values below two nodes that differ in one of those bits, and only these
    two meet.  A pair of nodes is dropped when its differing bits exceed the
    budget, or when all values below both are in one component already, so
    dense groups cost about as much as they have members.  Budgets of one and
    two errors go first to that end.  With ``marks`` (rows of unsigned 64-bit
    words) a pair is a link only if those differ in at most ``most`` bits;
    equal values are links.
    """
    n = len(values)
    label = np.arange(n)
    if n < 2:
        return label
    block = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    equal = np.flatnonzero((values[1:] == values[:-1]) & (block[1:] == block[:-1])) + 1
    merge(label, equal - 1, equal)
    zeros: dict[int, np.ndarray] = {}

    def zeros_before(depth: int) -> np.ndarray:
        if depth not in zeros:
            bit = (values >> np.uint64(63 - depth)) & np.uint64(1)
            zeros[depth] = np.concatenate(([0], np.cumsum(bit == 0))).astype(np.int32)
        return zeros[depth]

    roots = _roots(values, starts, shape, split, cross)
    ring = ~np.uint64(0) << np.uint64(64 - shape.width) if shape.width < 64 else ~np.uint64(0)
    for allowed in sorted({1, 2, errors} & set(range(errors + 1))) or [errors]:
        budget = np.minimum(prefix_budgets(errors, shape), allowed + shape.slack * (np.arange(65) > shape.width))
        run = _runs(label)
        stack = [(depth, pairs[:, pairs[4] <= budget[depth]]) for depth, pairs in roots]
        fresh = 0
        while stack:
            depth, pairs = stack.pop()
            if pairs.shape[1] > BATCH_PAIRS:
                stack.append((depth, pairs[:, BATCH_PAIRS:]))
                pairs = pairs[:, :BATCH_PAIRS]
            pairs = _differing(pairs, label, run)
            single = (pairs[1] - pairs[0] == 1) & (pairs[3] - pairs[2] == 1)
            a, b = pairs[0, single], pairs[2, single]
            if len(a):
                near = _near(values, a, b, allowed, ring, marks, most)
                if near.any():
                    merge(label, a[near], b[near])
                    fresh += int(near.sum())
                    if fresh > n // 4:
                        run, fresh = _runs(label), 0
                pairs = pairs[:, ~single]
            if pairs.shape[1] and depth < 64:
                pairs = _children(pairs, zeros_before(depth), int(budget[depth + 1]))
                if pairs.shape[1]:
                    stack.append((depth + 1, pairs))
            elif pairs.shape[1] and marks is not None:
                # values below a node of full depth are equal and in one component: one of each may stand for them
                a, b = pairs[0], pairs[2]
                near = _near(values, a, b, allowed, ring, marks, most)
                merge(label, a[near], b[near])
    return label


def _roots(values: np.ndarray, starts: np.ndarray, shape: Shape, split: np.ndarray | None, cross: np.ndarray | None) -> list[tuple[int, np.ndarray]]:
    """The first pairs of nodes, by depth: each block with itself, or the two halves of a cross cell."""
    lo, hi = starts[:-1], starts[1:]
    if split is None or cross is None:
        split, cross = np.zeros(len(lo), np.int64), np.zeros(len(lo), bool)
    found = []
    for extra in np.unique(split).tolist():
        mine = (split == extra) & (hi - lo > 1)
        own = np.flatnonzero(mine & ~cross)
        pairs = [np.stack((lo[own], hi[own], lo[own], hi[own], np.zeros(len(own), np.int64)))]
        two = np.flatnonzero(mine & cross)
        prefix = values >> np.uint64(64 - shape.root - extra)
        mid = np.array([lo[k] + int(np.searchsorted(prefix[lo[k] : hi[k]], prefix[lo[k]], "right")) for k in two], np.int64)
        pairs.append(np.stack((lo[two], mid, mid, hi[two], np.ones(len(two), np.int64)))[:, mid < hi[two]])
        found.append((shape.root + extra, np.concatenate(pairs, axis=1)))
    return found


def _near(values: np.ndarray, a: np.ndarray, b: np.ndarray, allowed: int, ring: np.uint64, marks: np.ndarray | None, most: int) -> np.ndarray:
    near = (np.bitwise_count((values[a] ^ values[b]) & ring) <= allowed) & (a != b)
    if marks is not None:
        near &= np.bitwise_count(marks[a] ^ marks[b]).sum(axis=1, dtype=np.int64) <= most
    return near


def _runs(label: np.ndarray) -> np.ndarray:
    """An id for each stretch of neighbours in one component."""
    return np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))


def _differing(pairs: np.ndarray, label: np.ndarray, run: np.ndarray) -> np.ndarray:
    alo, ahi, blo, bhi, _ = pairs
    one = (run[alo] == run[ahi - 1]) & (run[blo] == run[bhi - 1]) & (label[alo] == label[blo])
    return pairs[:, ~one]


def _children(pairs: np.ndarray, zeros: np.ndarray, budget: int) -> np.ndarray:
    alo, ahi, blo, bhi, err = pairs
    amid, bmid = alo + zeros[ahi] - zeros[alo], blo + zeros[bhi] - zeros[blo]
    same = alo == blo
    more = err < budget
    made = []
    for x, y, u, v, e, wanted in (
        (alo, amid, blo, bmid, err, None),
        (amid, ahi, bmid, bhi, err, None),
        (alo, amid, bmid, bhi, err + 1, more),
        (amid, ahi, blo, bmid, err + 1, more & ~same),
    ):
        keep = (x < y) & (u < v)
        if wanted is None:
            keep &= ~(same & (y - x == 1))
        else:
            keep &= wanted
        made.append(np.stack((x[keep], y[keep], u[keep], v[keep], e[keep])))
    return np.concatenate(made, axis=1)
