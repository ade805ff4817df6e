"""Sharding by best-fit-decreasing bin packing of groups that stay together."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import SPAN, running_sums
from .storage import saved

SHARDS = 16
GROWTH = 1.0005


@dataclass
class _Node:
    key: tuple[int, int]
    level: int = 1
    left: _Node | None = None
    right: _Node | None = None


class Rooms:
    """Open bins as ``(room, bin)`` in a balanced tree of the AA kind: finding, taking and putting back cost its height."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    def put(self, key: tuple[int, int]) -> None:
        self.root = _added(self.root, key)

    def take(self, size: int) -> tuple[int, int] | None:
        """The bin with the least room that holds ``size``, taken out; None if none does."""
        node, best = self.root, None
        while node:
            if node.key[0] >= size:
                best, node = node.key, node.left
            else:
                node = node.right
        if best is not None:
            self.root = _removed(self.root, best)
        return best


def _skewed(node: _Node) -> _Node:
    left = node.left
    if left is None or left.level != node.level:
        return node
    node.left, left.right = left.right, node
    return left


def _split(node: _Node) -> _Node:
    right = node.right
    if right is None or right.right is None or right.right.level != node.level:
        return node
    node.right, right.left = right.left, node
    right.level += 1
    return right


def _added(node: _Node | None, key: tuple[int, int]) -> _Node:
    if node is None:
        return _Node(key)
    if key < node.key:
        node.left = _added(node.left, key)
    else:
        node.right = _added(node.right, key)
    return _split(_skewed(node))


def _removed(node: _Node, key: tuple[int, int]) -> _Node | None:
    if key < node.key:
        node.left = _removed(node.left, key)
    elif key > node.key:
        node.right = _removed(node.right, key)
    elif node.left is None:
        return node.right
    else:
        after = node.right
        while after.left:
            after = after.left
        node.key = after.key
        node.right = _removed(node.right, after.key)
    level = 1 + min(node.left.level if node.left else 0, node.right.level if node.right else 0)
    if level < node.level:
        node.level = level
        if node.right and node.right.level > level:
            node.right.level = level
    node = _skewed(node)
    if node.right:
        node.right = _skewed(node.right)
        if node.right.right:
            node.right.right = _skewed(node.right.right)
    node = _split(node)
    if node.right:
        node.right = _split(node.right)
    return node


def best_fit(classes: list[tuple[int, int]], bins: int | None, capacity: int) -> list[tuple[int, int, int, int]] | None:
    """Put ``count`` groups of each ``size`` (sizes falling) into the tightest open bin that holds them.

    A bin is opened only when no open one has the room, so bins of a fixed
    capacity are few.  A bin that took one group of a size is the tightest for
    the next of that size, so a size's groups are placed in runs.  Returns
    runs ``(size, first, count, bin)``, ``first`` counting the size's groups
    from 0, or None when ``bins`` (None: any number) don't suffice or a group
    exceeds the capacity.
    """
    rooms, opened, runs = Rooms(), 0, []
    for size, count in classes:
        first = 0
        while count:
            found = rooms.take(size)
            if found is None:
                if size > capacity or opened == bins:
                    return None
                found, opened = (capacity, opened), opened + 1
            left, where = found
            taken = min(count, left // size)
            rooms.put((left - taken * size, where))
            runs.append((size, first, taken, where))
            first, count = first + taken, count - taken
    return runs


def fixed_capacity(classes: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int]]:
    """Best fit into as few bins of ``capacity`` as it needs; a group beyond it has a bin alone."""
    classes = sorted(classes, reverse=True)
    alone = [(size, k) for size, count in classes if size > capacity for k in range(count)]
    runs = best_fit([c for c in classes if c[0] <= capacity], None, capacity)
    return [(size, k, 1, b) for b, (size, k) in enumerate(alone)] + [(s, f, n, b + len(alone)) for s, f, n, b in runs]


def least_capacity(classes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int, int]]:
    """Best fit into ``bins`` of the least capacity, in steps of ``GROWTH``, that suffices.

    A group of at least an equal share of what is left takes a bin alone, so
    that it doesn't set the others' capacity.
    """
    classes = sorted(classes, reverse=True)
    left, total, alone, rest = bins, sum(s * n for s, n in classes), [], []
    for size, count in classes:
        taken = 0
        while taken < count and left > 1 and size * left >= total and not rest:
            alone.append((size, taken, 1, bins - left))
            taken, left, total = taken + 1, left - 1, total - size
        if taken < count:
            rest.append((size, taken, count - taken))
    if not rest:
        return alone
    sizes = [(size, count) for size, _, count in rest]
    capacity = max(sizes[0][0], -(-total // left))
    while (runs := best_fit(sizes, left, capacity)) is None:
        capacity = max(capacity + 1, int(capacity * GROWTH))
    skipped = {size: first for size, first, _ in rest}
    return alone + [(size, first + skipped[size], count, where + bins - left) for size, first, count, where in runs]


def assign_shards(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", capacity: int | None = None) -> DataFrame:
    """A shard and a slot for each document, equal texts together.

    With ``capacity`` (bytes) there are as many shards as best fit needs;
    without, the capacity is the least with which ``shards`` suffice.

    A document's size is its UTF-8 bytes (null text: none) and 1, a group's
    that of its documents.  Groups sorted by size enter the shard with the
    least room that still holds them.  That needs one row for each distinct
    group size, not for each group: these rows go to one task, and there are
    at most the square root of twice the corpus's bytes.  Groups of one size
    are dealt to its runs by rank.  Slots count a shard's rows from 0.

    Columns: ``key, size, text_crc32, text_md5, shard, slot``.  Null text is a
    group of its own; repeated rows are documents of one group; an empty table
    gives no rows; a group larger than an equal share has a shard alone, which
    exceeds the others.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.when(F.col("text").isNull(), "null").otherwise(F.md5(text.cast("binary")))
    rows = saved(docs.select(F.col(key).alias("_key"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), digest.alias("text_md5")), "shard-sizes")
    groups = saved(rows.groupBy("text_md5").agg(F.sum("size").alias("_group"), F.min("text_crc32").alias("_crc")), "shard-groups")

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classes = [(int(s), int(n)) for part in parts for s, n in zip(part["_group"], part["n"])]
        runs = least_capacity(classes, shards) if capacity is None else fixed_capacity(classes, capacity)
        yield pd.DataFrame(runs, columns=["_size", "_first", "_count", "shard"])

    classes = groups.groupBy("_group").agg(F.count("*").alias("n"))
    runs = saved(classes.coalesce(1).mapInPandas(fill, "_size long, _first long, _count long, shard int"), "shard-runs")
    n_groups = groups.count()
    # positions from the digest spread the groups of one size evenly
    placed = groups.withColumn("_position", (F.hash("text_md5").cast("long") + F.lit(SPAN // 2)))
    ranked = running_sums(placed, ["_group"], "_position", [F.col("text_md5")], {"_rank": F.lit(1)}, n_groups)
    # a size's runs lie in as many shards at most: its groups are split by rank within the join
    within = (F.col("_group") == F.col("_size")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_count"))
    homes = ranked.join(runs, within).select(F.col("text_md5").alias("_md5"), "shard")
    sharded = rows.join(homes, F.col("text_md5") == F.col("_md5")).drop("_md5")
    sharded = sharded.withColumn("_position", F.xxhash64("_key", "text_md5").bitwiseAND(F.lit(SPAN - 1)))
    slotted = running_sums(sharded, ["shard"], "_position", [F.col("_key"), F.col("text_md5")], {"slot": F.lit(1)}, rows.count())
    return slotted.select(F.col("_key").alias(key), "size", "text_crc32", "text_md5", "shard", "slot")
