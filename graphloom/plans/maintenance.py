"""Keeping views current: dependencies, which changes matter, and merging deltas."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph
from graphloom.sources.changelog import EDGE_OPS, REMOVE_VERTEX, VERTEX_OPS, fold
from graphloom.sources.shared import saved

from .sqlviews import relations
from .views import VALUE_KEYS, Aggregation, Analytics, Lookup, SqlQuery, View, compute, parts_of

#: Fixed: algorithms that only edges and endpoints decide, but for how many vertices there are.
BY_TOPOLOGY = {"pagerank", "connectivity", "connected_components", "strongly_connected", "shortest_path", "path_exists", "degree_centrality", "closeness", "betweenness", "eigenvector", "triangle_count", "clustering_coefficient", "k_core", "all_paths"}
COUNTS_VERTICES = {"pagerank", "connectivity", "connected_components", "strongly_connected", "degree_centrality", "closeness", "betweenness", "eigenvector", "clustering_coefficient"}


class Dependencies:
    """Which views read which; sources come first."""

    def __init__(self) -> None:
        self.reads: dict[str, set[str]] = {}
        self.dirty: set[str] = set()

    def add(self, view: str, reads: tuple[str, ...] = ()) -> None:
        before = {k: set(v) for k, v in self.reads.items()}
        self.reads.setdefault(view, set()).update(reads)
        for name in reads:
            self.reads.setdefault(name, set())
        try:
            self.order()
        except CycleError:
            self.reads = before
            raise

    def order(self, names: set[str] | None = None) -> list[str]:
        found = TopologicalSorter({k: sorted(v) for k, v in sorted(self.reads.items())}).static_order()
        return [n for n in found if names is None or n in names]

    def dependents(self, view: str) -> set[str]:
        """Views that read this one, directly or not."""
        found, waiting = set(), [view]
        while waiting:
            at = waiting.pop()
            fresh = {k for k, v in self.reads.items() if at in v} - found
            found |= fresh
            waiting.extend(fresh)
        return found

    def mark(self, view: str) -> None:
        self.dirty |= {view} | self.dependents(view)

    def clean(self, view: str) -> None:
        self.dirty.discard(view)

    def pending(self) -> list[str]:
        return self.order(self.dirty)


def relevant(kind: Any, changes: DataFrame) -> DataFrame:
    """The changes that can alter a view of this kind."""
    vertex, edge = F.col("op").isin(*VERTEX_OPS), F.col("op").isin(*EDGE_OPS)
    if isinstance(kind, Lookup):
        return changes.where(vertex & F.col("id").isin(list(kind.keys)) if kind.keys else vertex)
    if isinstance(kind, Aggregation):
        return changes.where(vertex)
    if isinstance(kind, Analytics):
        # removing a vertex takes its edges along
        return changes.where(edge | vertex if kind.algorithm in COUNTS_VERTICES else edge | (F.col("op") == REMOVE_VERTEX))
    if isinstance(kind, SqlQuery):
        named = set(relations(kind.text))
        wanted = F.lit(False)
        wanted = wanted | vertex if named & {"vertices", "vertex"} else wanted
        return changes.where(wanted | edge | (F.col("op") == REMOVE_VERTEX) if named & {"edges", "edge", "graph"} else wanted)
    return changes


def signed_values(before: DataFrame, after: DataFrame, keys: DataFrame, view: Aggregation) -> DataFrame:
    """Old images at -1 and new ones at +1 of the vertices in ``keys (id)``, as ``groups..., x, diff``."""

    def images(df: DataFrame, diff: int) -> DataFrame:
        rows = df.join(keys, "id", "left_semi")
        for key, wanted in view.filters:
            rows = rows.where(F.col(key) == wanted)
        found = [F.col(k).cast("double") for k in VALUE_KEYS if k in df.columns and df.schema[k].dataType.typeName() not in ("string", "boolean")]
        value = F.coalesce(*found) if found else F.lit(None).cast("double")
        return rows.select(*view.group_by, value.alias("x"), F.lit(diff).alias("diff"))

    return images(before, -1).unionByName(images(after, 1))


def merge_state(state: DataFrame | None, delta: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """A multiset of values by group, ``groups..., x, n``, after a signed delta.

    Counts of each value make least and largest values retractable: nothing is
    clamped and nothing is looked up in the whole table.
    """
    changed = delta.groupBy(*groups, "x").agg(F.sum("diff").alias("n"))
    both = changed if state is None else state.unionByName(changed)
    return both.groupBy(*groups, "x").agg(F.sum("n").alias("n")).where("n <> 0")


def state_rows(state: DataFrame, view: Aggregation) -> DataFrame:
    """The view's rows from its multiset."""
    total, count = F.coalesce(F.sum(F.col("x") * F.col("n")), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))
    by = {"count": count.cast("double"), "sum": total, "min": F.coalesce(F.min("x"), F.lit(0.0)), "max": F.coalesce(F.max("x"), F.lit(0.0))}
    by["avg"] = by["average"] = F.coalesce(F.try_divide(total, count), F.lit(0.0))
    return state.groupBy(*view.group_by).agg(by[view.function].alias("value"))


@dataclass
class Update:
    view: str
    changes: int
    ms: float
    full: bool


@dataclass
class Engine:
    """Views over one graph, brought up to date changeset by changeset.

    ``graph`` is the state after all processed changes.  ``batch_size``
    changesets are folded together.  Processing a batch again under the same
    ``batch_id`` does nothing, so it may serve ``foreachBatch``.
    """

    graph: PropertyGraph
    batch_size: int = 1000
    most_pending: int = 10_000
    clock: Callable[[], float] = time.time
    views: dict[str, View] = field(default_factory=dict)
    states: dict[tuple[str, int], DataFrame] = field(default_factory=dict)
    results: dict[str, Any] = field(default_factory=dict)
    queue: list[DataFrame] = field(default_factory=list)
    dependencies: Dependencies = field(default_factory=Dependencies)
    history: list[Update] = field(default_factory=list)
    done: set[Any] = field(default_factory=set)

    def register(self, view: View) -> None:
        view.validate()
        self.dependencies.add(view.name, view.reads)
        self.views[view.name] = view
        self.force(view.name)

    def force(self, name: str) -> Any:
        """Compute a view anew from the current graph."""
        view, began = self.views[name], time.perf_counter()
        for k, part in enumerate(parts_of(view.kind)):
            if isinstance(part, Aggregation):
                delta = signed_values(self.graph.vertices.limit(0), self.graph.vertices, self.graph.vertices.select("id"), part)
                self.states[name, k] = saved(merge_state(None, delta, part.group_by), "view-state")
        self.results[name] = self._rows(view)
        view.refreshed = self.clock()
        self.dependencies.clean(name)
        self.history.append(Update(name, 0, (time.perf_counter() - began) * 1000, True))
        return self.results[name]

    def _rows(self, view: View) -> Any:
        found = []
        for k, part in enumerate(parts_of(view.kind)):
            found.append(state_rows(self.states[view.name, k], part) if isinstance(part, Aggregation) else compute(self.graph, part))
        return tuple(found) if len(found) > 1 else found[0]

    def submit(self, changes: DataFrame) -> None:
        if len(self.queue) >= self.most_pending:
            raise OverflowError("too many changesets are waiting")
        self.queue.append(changes)

    def process(self, changes: DataFrame | None = None, batch_id: Any = None) -> list[Update]:
        """Fold what waits into the graph and update the views that it touches, sources first."""
        if batch_id is not None and batch_id in self.done:
            return []
        if changes is not None:
            self.submit(changes)
        made: list[Update] = []
        while self.queue:
            batch, self.queue = self.queue[: self.batch_size], self.queue[self.batch_size :]
            whole = batch[0]
            for more in batch[1:]:
                whole = whole.unionByName(more)
            made += self._fold(saved(whole, "changes"))
        if batch_id is not None:
            self.done.add(batch_id)
        return made

    def _fold(self, changes: DataFrame) -> list[Update]:
        before = self.graph
        ops = {r["op"] for r in changes.select("op").distinct().collect()}  # at most six
        after = fold(before, changes, ops)
        # a table that no change touches is not written again
        self.graph = PropertyGraph(
            after.vertices if after.vertices is before.vertices else saved(after.vertices, "graph"),
            after.edges if after.edges is before.edges else saved(after.edges, "graph"),
        )
        counts: dict[str, int] = {}
        for name, view in self.views.items():
            counts[name] = sum(relevant(p, changes).count() for p in parts_of(view.kind))
            if counts[name]:
                self.dependencies.mark(name)
        keys = changes.where(F.col("op").isin(*VERTEX_OPS)).select("id").distinct()
        made = []
        for name in [n for n in self.dependencies.pending() if n in self.views]:
            view, began = self.views[name], time.perf_counter()
            for k, part in enumerate(parts_of(view.kind)):
                if isinstance(part, Aggregation):
                    delta = signed_values(before.vertices, self.graph.vertices, keys, part)
                    self.states[name, k] = saved(merge_state(self.states[name, k], delta, part.group_by), "view-state")
            self.results[name] = self._rows(view)
            view.refreshed = self.clock()
            self.dependencies.clean(name)
            made.append(Update(name, counts.get(name, 0), (time.perf_counter() - began) * 1000, False))
        self.history += made
        return made

    def metrics(self) -> dict[str, float]:
        ms = [u.ms for u in self.history]
        return {"updates": len(ms), "changes": sum(u.changes for u in self.history), "mean_ms": sum(ms) / len(ms) if ms else 0.0, "views": len(self.views)}
