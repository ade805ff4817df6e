"""Choosing a view that answers a query pattern, and keeping views' rows at three storage levels."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from .views import Aggregation, Analytics, Hybrid, Lookup, SqlQuery, View, fingerprint

#: Fixed: what a kind of view takes before it has been timed, in milliseconds.
FIRST_LATENCY = {Lookup: 1.0, Aggregation: 2.0, Analytics: 5.0, Hybrid: 3.0, SqlQuery: 10.0}


@dataclass(frozen=True)
class VertexLookup:
    keys: tuple[int, ...]


@dataclass(frozen=True)
class PropertySearch:
    filters: tuple[tuple[str, Any], ...]


@dataclass(frozen=True)
class AggregateQuery:
    function: str


@dataclass(frozen=True)
class AnalyticsQuery:
    algorithm: str


@dataclass(frozen=True)
class EdgeTraversal:
    start: int
    depth: int = 1


@dataclass(frozen=True)
class HybridQuery:
    parts: tuple[Any, ...]


class NoView(LookupError):
    """No registered view answers the pattern."""


@dataclass(frozen=True)
class Decision:
    view: str
    confidence: int
    latency_ms: float


def confidence(pattern: Any, kind: Any) -> int:
    """0 to 100: how well a view of this kind answers the pattern."""
    if isinstance(kind, Hybrid):
        if isinstance(pattern, PropertySearch):
            return 50 if any(isinstance(p, SqlQuery) for p in kind.parts) else 0
        return max((confidence(pattern, p) for p in kind.parts), default=0)
    if isinstance(pattern, HybridQuery):
        return max((confidence(p, kind) for p in pattern.parts), default=0)
    if isinstance(kind, SqlQuery):
        return 50
    if isinstance(pattern, VertexLookup) and isinstance(kind, Lookup):
        if not kind.keys or not pattern.keys:
            return 100
        return 100 * len(set(pattern.keys) & set(kind.keys)) // len(set(pattern.keys))
    if isinstance(pattern, AggregateQuery) and isinstance(kind, Aggregation):
        return 95 if pattern.function == kind.function else 0
    if isinstance(pattern, AnalyticsQuery) and isinstance(kind, Analytics):
        return 90 if pattern.algorithm == kind.algorithm else 0
    if isinstance(pattern, EdgeTraversal) and isinstance(kind, Analytics):
        return 75 if kind.algorithm in ("graph_traversal", "path_exists") else 0
    return 0


class Router:
    """Routes to the surest view, then the fastest, then the first by name."""

    def __init__(self) -> None:
        self.views: dict[str, View] = {}
        self.times: dict[str, tuple[int, float]] = {}

    def add(self, view: View) -> None:
        self.views[view.name] = view

    def latency(self, name: str) -> float:
        runs, mean = self.times.get(name, (0, 0.0))
        return mean if runs else FIRST_LATENCY[type(self.views[name].kind)]

    def timed(self, name: str, ms: float) -> None:
        runs, mean = self.times.get(name, (0, 0.0))
        self.times[name] = runs + 1, mean + (ms - mean) / (runs + 1)

    def route(self, pattern: Any) -> Decision:
        found = [Decision(n, c, self.latency(n)) for n, v in self.views.items() if (c := confidence(pattern, v.kind)) > 0]
        if not found:
            raise NoView(repr(pattern))
        return min(found, key=lambda d: (-d.confidence, d.latency_ms, d.view))

    def execute(self, pattern: Any, cache: ViewCache, load: Callable[[str], Any], fallback: Callable[[], Any] | None = None) -> Any:
        """The routed view's rows from the cache, or loaded and put there; ``fallback`` where no view fits."""
        try:
            name = self.route(pattern).view
        except NoView:
            if fallback is None:
                raise
            return fallback()
        began = time.perf_counter()
        key = fingerprint(self.views[name].kind)
        found = cache.get(name, key)
        if found is None:
            found = load(name)
            cache.put(name, key, found, self.views[name].kind, (time.perf_counter() - began) * 1000)
        self.timed(name, (time.perf_counter() - began) * 1000)
        return found

    def warm(self, names: list[str], cache: ViewCache, load: Callable[[str], Any]) -> int:
        """Load views and fill their storage; the number filled."""
        for name in names:
            found = load(name)
            cache.put(name, fingerprint(self.views[name].kind), found, self.views[name].kind, 0.0)
            if isinstance(found, DataFrame):
                found.count()
        return len(names)


#: Fixed: points of a view's priority by estimated size and by kind.
SIZE_POINTS = ((1 << 20, 30), (10 << 20, 20), (100 << 20, 10))
KIND_POINTS = {Lookup: 25, Aggregation: 20, Analytics: 15, Hybrid: 10, SqlQuery: 5}
LEVELS = {"L1": StorageLevel.MEMORY_ONLY, "L2": StorageLevel.MEMORY_AND_DISK, "L3": StorageLevel.DISK_ONLY}


def priority(cost_ms: float, size: int, kind: Any) -> float:
    by_size = next((points for bound, points in SIZE_POINTS if size < bound), 5)
    return min(cost_ms / 1000 * 20, 40) + by_size + KIND_POINTS.get(type(kind), 5)


@dataclass
class Level:
    """One level: a byte budget, a time to live and a rule for what goes first."""

    name: str
    capacity: int | None
    ttl: float
    policy: str  # lru, lfu, adaptive
    clock: Callable[[], float] = time.time
    entries: OrderedDict = field(default_factory=OrderedDict)
    hits: int = 0
    misses: int = 0
    evictions: int = 0

    def get(self, key: str) -> Any | None:
        entry = self.entries.get(key)
        if entry and self.clock() - entry["at"] > self.ttl:
            self.remove(key)
            entry = None
        if entry is None:
            self.misses += 1
            return None
        self.hits += 1
        entry["uses"] += 1
        self.entries.move_to_end(key)
        return entry["data"]

    def put(self, key: str, data: Any, size: int) -> bool:
        """False where the entry alone exceeds the level."""
        if self.capacity is not None and size > self.capacity:
            return False
        self.remove(key)
        while self.capacity is not None and self.entries and self.used() + size > self.capacity:
            self.remove(self._victim())
            self.evictions += 1
        self.entries[key] = {"data": data, "size": size, "at": self.clock(), "uses": 0}
        if isinstance(data, DataFrame):
            data.persist(LEVELS[self.name])
        return True

    def _victim(self) -> str:
        if self.policy == "lru":
            return next(iter(self.entries))
        if self.policy == "lfu":
            return min(self.entries, key=lambda k: self.entries[k]["uses"])
        cold = [k for k, e in self.entries.items() if e["uses"] < 2]
        return cold[0] if cold else next(iter(self.entries))

    def remove(self, key: str) -> bool:
        entry = self.entries.pop(key, None)
        if entry and isinstance(entry["data"], DataFrame):
            entry["data"].unpersist()
        return entry is not None

    def used(self) -> int:
        return sum(e["size"] for e in self.entries.values())


class ViewCache:
    """Views' rows at memory, memory-and-disk or disk level, by priority."""

    def __init__(self, clock: Callable[[], float] = time.time):
        self.levels = [Level("L1", 50 << 20, 60, "lru", clock), Level("L2", 200 << 20, 300, "adaptive", clock), Level("L3", None, 3600, "lfu", clock)]

    def get(self, view: str, key: str) -> Any | None:
        return next((d for level in self.levels if (d := level.get(f"{view}:{key}")) is not None), None)

    def put(self, view: str, key: str, data: Any, kind: Any, cost_ms: float, size: int | None = None) -> str:
        """The level chosen; an entry that is too large goes to the next."""
        size = estimated_size(data) if size is None else size
        points = priority(cost_ms, size, kind)
        start = 0 if points >= 80 else 1 if points >= 40 else 2
        self.remove(view, key)
        for level in self.levels[start:]:
            if level.put(f"{view}:{key}", data, size):
                return level.name
        raise AssertionError("the last level has no bound")

    def remove(self, view: str, key: str) -> bool:
        return any([level.remove(f"{view}:{key}") for level in self.levels])

    def clear(self) -> None:
        for level in self.levels:
            for key in list(level.entries):
                level.remove(key)

    def stats(self) -> dict[str, dict[str, float]]:
        out = {}
        for level in self.levels:
            asked = level.hits + level.misses
            out[level.name] = {"entries": len(level.entries), "bytes": level.used(), "hits": level.hits, "misses": level.misses, "evictions": level.evictions, "hit_ratio": level.hits / asked if asked else 0.0}
        hits, asked = sum(s["hits"] for s in out.values()), sum(s["hits"] + s["misses"] for s in out.values())
        return {**out, "all": {"hits": hits, "misses": asked - hits, "hit_ratio": hits / asked if asked else 0.0}}


def estimated_size(data: Any) -> int:
    """The optimizer's estimate for a DataFrame; nothing is computed."""
    if isinstance(data, DataFrame):
        return int(data._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return 1
