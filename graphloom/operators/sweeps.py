"""Breadth-first sweeps from many vertices, in tasks that each hold all edges and some of the sources."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A task takes some 60 bytes an edge; graphs with more go through joins.
MOST_EDGES = 8_000_000
LANES = 64


def dealt(edges: DataFrame, sources: DataFrame, everywhere: bool = False) -> DataFrame:
    """``own, src, dst, part``: a copy of ``edges`` for each core, and its share of ``sources (id)``, or all of them (``own``, as src)."""
    parts = edges.sparkSession.sparkContext.defaultParallelism
    each = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    copies = edges.where("src is not null and dst is not null").select(each.alias("part"), F.lit(False).alias("own"), "src", "dst")
    part = each if everywhere else F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    begin = sources.where("id is not null").select(part.alias("part"), F.lit(True).alias("own"), F.col("id").alias("src"), F.col("id").alias("dst"))
    return copies.unionByName(begin).repartitionById(parts, "part").select("own", "src", "dst", "part")


def _read(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All ids, sorted, and by place in them the sources and the edges' ends."""
    edges, begin = [np.zeros((2, 0), np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        own = batch.column(0).to_numpy(zero_copy_only=False)
        src, dst = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        begin.append(src[own])
        edges.append(np.stack((src[~own], dst[~own])))
    sources, both = np.concatenate(begin), np.concatenate(edges, axis=1)
    edges.clear()
    ids = np.unique(np.concatenate((sources, both[0], both[1])))
    return ids, np.searchsorted(ids, sources), *(np.searchsorted(ids, end).astype(np.int32) for end in both)


def hop_sums(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``id, far, n``: for each source the hops to all vertices that it reaches, and how many those are.

    The sources of a block are the bits of a word, so one pass over the edges
    takes all of them a hop further.
    """

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sources, src, dst = _read(batches)
        order = np.argsort(dst, kind="stable")
        src, (ends, starts) = src[order], np.unique(dst[order], return_index=True)
        for at in range(0, len(sources), LANES):
            block = sources[at : at + LANES]
            front = np.zeros(len(ids), np.uint64)
            front[block] = np.uint64(1) << np.arange(len(block), dtype=np.uint64)
            seen, far, n, depth = front.copy(), np.zeros(LANES, np.int64), np.zeros(LANES, np.int64), 0
            while len(ends):
                depth += 1
                fresh = np.bitwise_or.reduceat(front[src], starts) & ~seen[ends]
                moved = np.flatnonzero(fresh)
                if not len(moved):
                    break
                front = np.zeros(len(ids), np.uint64)
                front[ends[moved]] = fresh[moved]
                seen |= front
                found = np.unpackbits(fresh[moved].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                far += depth * found
                n += found
            yield pa.RecordBatch.from_arrays([pa.array(ids[block]), pa.array(far[: len(block)]), pa.array(n[: len(block)])], names=["id", "far", "n"])

    return dealt(edges, sources).mapInArrow(sweep, "id long, far long, n long")


def strong_parts(edges: DataFrame) -> DataFrame:
    """``id, colour`` of all ends of ``edges``: the least id in the strong component, by Tarjan's search in one task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [np.stack((b.column(0).to_numpy(), b.column(1).to_numpy())) for b in batches]
        ids, both = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1), return_inverse=True)
        src, dst = both.reshape(2, -1)
        n = len(ids)
        ends = array("q", np.cumsum(np.bincount(src, minlength=n)).tobytes())
        at = array("q", [0, *ends[:-1]])
        to = array("q", dst[np.argsort(src, kind="stable")].tobytes())
        number, low, least = array("q", bytes(8 * n)), array("q", bytes(8 * n)), array("q", [-1]) * n
        count, open_ids, way = 0, [], []
        for start in range(n):
            if number[start]:
                continue
            way.append(start)
            while way:
                v = way[-1]
                if not number[v]:
                    count += 1
                    number[v] = low[v] = count
                    open_ids.append(v)
                if at[v] < ends[v]:
                    w = to[at[v]]
                    at[v] += 1
                    if not number[w]:
                        way.append(w)
                    elif least[w] < 0 and number[w] < low[v]:
                        low[v] = number[w]
                    continue
                way.pop()
                if way and low[v] < low[way[-1]]:
                    low[way[-1]] = low[v]
                if low[v] == number[v]:
                    part = []
                    while not part or part[-1] != v:
                        part.append(open_ids.pop())
                    first = min(part)
                    for w in part:
                        least[w] = first
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[np.array(least, np.int64)])], names=["id", "colour"])

    return edges.select("src", "dst").repartition(1).mapInArrow(search, "id long, colour long")


def _trees(degree: np.ndarray, first: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``up, root, depth``: where a vertex with one edge out goes, where its way through such vertices ends, after how many steps.

    Others are roots, and of a ring of such vertices the first one.
    """
    size = len(degree)
    up = np.arange(size)
    single = np.flatnonzero(degree == 1)
    up[single] = dst[first[single]]
    rounds = range(size.bit_length())
    least, ahead = np.arange(size), up
    for _ in rounds:
        least, ahead = np.minimum(least, least[ahead]), ahead[ahead]
    ring = np.unique(ahead)  # and the roots
    cut = ring[least[ring] == ring]
    up[cut] = cut
    depth, root = (up != np.arange(size)).astype(np.int64), up
    for _ in rounds:
        depth, root = depth + depth[root], root[root]
    return up, root, depth


def path_shares(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``id, share``: what each task's sources give every vertex inside their shortest paths, by Brandes' recursion.

    All paths from a vertex with one edge out go through the next one, so a
    sweep from the end of such ways does for all sources on them: a vertex
    that it reaches is a target of those that don't pass it on their way, and
    what lies on a way is between its start and all that comes after.
    """
    parts = edges.sparkSession.sparkContext.defaultParallelism

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: set[int] = set()

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own.update(batch.column(3).unique().to_pylist())
                yield batch

        ids, sources, src, dst = _read(noted())
        size = len(ids)
        order = np.argsort(src, kind="stable")
        dst, degree = dst[order], np.bincount(src, minlength=size)
        first = np.cumsum(degree) - degree
        up, root, depth = _trees(degree, first, dst)
        begins = np.zeros(size)
        begins[sources] = 1.0
        below = begins.copy()  # sources at and before each vertex on their ways
        by_depth = np.argsort(depth, kind="stable")
        for level in _levels(by_depth, depth)[:0:-1]:
            np.add.at(below, up[level], below[level])
        members = np.lexsort((depth, root))
        member_of = root[members]
        roots = np.flatnonzero(up == np.arange(size))
        roots = roots[below[roots] > 0]
        roots = roots[np.isin(np.arange(len(roots)) % parts, list(own))]
        total, slot, steps = np.zeros(size), np.zeros(size, np.int64), np.zeros(size)
        bounds = np.searchsorted(member_of, roots), np.searchsorted(member_of, roots, "right")
        for end, lo, hi in zip(roots.tolist(), *(b.tolist() for b in bounds)):
            seen, paths = np.zeros(size, bool), np.zeros(size)
            seen[end], paths[end] = True, 1.0
            front, levels = np.array([end], np.int32), []
            while True:
                many = degree[front]
                near = np.repeat(front, many)
                far = dst[np.arange(len(near)) + np.repeat(first[front] - (np.cumsum(many) - many), many)]
                new = ~seen[far]
                near, far = near[new], far[new]
                if not len(far):
                    break
                np.add.at(paths, far, paths[near])
                slot[far] = at = np.arange(len(far))
                front = far[slot[far] == at]
                seen[front] = True
                levels.append((near, far))
            tree = members[lo + 1 : hi]  # the root itself comes first
            targets = np.full(size, below[end])
            targets[tree] -= below[tree]
            share = np.zeros(size)
            for near, far in reversed(levels):
                starts = np.concatenate(([0], np.flatnonzero(near[1:] != near[:-1]) + 1))
                given = np.add.reduceat((targets[far] + share[far]) / paths[far], starts)
                share[near[starts]] = paths[near[starts]] * given
            share[end] = 0.0  # a path's ends don't count
            total += share
            if len(tree):
                reached = np.count_nonzero(seen) - 1
                ways = _levels(tree, depth)
                steps[end] = 0.0
                for level in ways:  # what the root reaches of a vertex's own way
                    steps[level] = steps[up[level]] + seen[level]
                after = begins[tree] * (reached - steps[tree])
                steps[tree] = after
                for level in reversed(ways):
                    np.add.at(steps, up[level], steps[level])
                total[tree] += steps[tree] - after + depth[tree] * (below[tree] - begins[tree])
                total[end] += steps[end]
        given = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids[given]), pa.array(total[given])], names=["id", "share"])

    return dealt(edges, sources, everywhere=True).mapInArrow(sweep, "id long, share double")


def _levels(vertices: np.ndarray, depth: np.ndarray) -> list[np.ndarray]:
    """``vertices``, sorted by depth, in pieces of one depth each."""
    return np.split(vertices, np.flatnonzero(np.diff(depth[vertices])) + 1) if len(vertices) else []
