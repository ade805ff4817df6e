"""Materialized views: what they hold, when they are stale, and where they are listed."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.predicates import NUMBERS, QueryError
from graphloom.model import PropertyGraph
from graphloom.operators import algorithms, shapes, traverse

from . import sqlviews

#: Fixed order in which a vertex's value is looked for.
VALUE_KEYS = ("value", "amount", "count", "score", "weight")
AGGREGATES = ("count", "sum", "avg", "average", "min", "max")
ANALYTICS = (
    "pagerank", "connectivity", "connected_components", "strongly_connected", "shortest_path", "path_exists", "degree_centrality",
    "closeness", "betweenness", "eigenvector", "triangle_count", "clustering_coefficient", "k_core", "all_paths",
)


@dataclass(frozen=True)
class Lookup:
    keys: tuple[int, ...] = ()  # none: every vertex


@dataclass(frozen=True)
class Aggregation:
    function: str
    group_by: tuple[str, ...] = ()
    filters: tuple[tuple[str, Any], ...] = ()


@dataclass(frozen=True)
class Analytics:
    algorithm: str
    parameters: tuple[tuple[str, Any], ...] = ()


@dataclass(frozen=True)
class SqlQuery:
    text: str


@dataclass(frozen=True)
class Hybrid:
    parts: tuple[Any, ...]


KINDS = {c.__name__: c for c in (Lookup, Aggregation, Analytics, SqlQuery, Hybrid)}


@dataclass(frozen=True)
class Refresh:
    """``interval``: seconds apart; ``event``: on changes, ``debounce`` seconds together; ``demand``: after ``ttl``; ``hybrid``: on changes or by interval."""

    policy: str = "demand"
    interval: float = 0.0
    debounce: float = 0.0
    ttl: float = 0.0
    on_event: bool = False

    def validate(self) -> None:
        if self.policy not in ("interval", "event", "demand", "hybrid"):
            raise ValueError(f"unknown refresh policy {self.policy}")
        if self.policy == "event" and self.debounce <= 0:
            raise ValueError("debounce must be positive")
        if self.policy in ("interval", "hybrid") and self.interval < 0.1 and not (self.policy == "hybrid" and self.on_event):
            raise ValueError("interval must be at least 100 ms")

    def due(self, refreshed: float, now: float) -> bool:
        since = now - refreshed
        if self.policy == "interval":
            return since >= self.interval
        if self.policy == "demand":
            return since > self.ttl
        return self.policy == "hybrid" and not self.on_event and since > self.interval


@dataclass
class View:
    name: str
    kind: Any
    refresh: Refresh = field(default_factory=Refresh)
    memory_mb: int = 1
    refreshed: float = 0.0  # the epoch: never
    reads: tuple[str, ...] = ()  # other views

    def validate(self) -> None:
        self.refresh.validate()
        if self.memory_mb <= 0:
            raise ValueError("memory estimate must be positive")
        for part in parts_of(self.kind):
            if isinstance(part, Aggregation) and part.function not in AGGREGATES:
                raise QueryError(f"unsupported aggregate {part.function}")
            if isinstance(part, Analytics) and part.algorithm not in ANALYTICS:
                raise QueryError(f"unsupported algorithm {part.algorithm}")
            if isinstance(part, SqlQuery):
                sqlviews.validate(part.text)

    def needs_refresh(self, now: float | None = None) -> bool:
        return self.refresh.due(self.refreshed, time.time() if now is None else now)


def parts_of(kind: Any) -> list[Any]:
    return [p for k in kind.parts for p in parts_of(k)] if isinstance(kind, Hybrid) else [kind]


def value_column(df: DataFrame, prefix: str = ""):
    """The first number among the value keys that the table has."""
    found = [F.col(f"{prefix}{k}").cast("double") for k in VALUE_KEYS if k in df.columns and isinstance(df.schema[k].dataType, NUMBERS)]
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def aggregate(vertices: DataFrame, view: Aggregation) -> DataFrame:
    """One row for each group with ``value``; averages are over all of a group's vertices, with or without a number.

    A missing least or largest value is 0.0, as is an average over none.
    """
    for key, wanted in view.filters:
        vertices = vertices.where(F.col(key) == wanted)
    value = value_column(vertices)
    total = F.coalesce(F.sum(value), F.lit(0.0))
    functions = {
        "count": F.count("*").cast("double"),
        "sum": total,
        "avg": F.coalesce(F.try_divide(total, F.count("*")), F.lit(0.0)),
        "min": F.coalesce(F.min(value), F.lit(0.0)),
        "max": F.coalesce(F.max(value), F.lit(0.0)),
    }
    function = {"average": "avg"}.get(view.function, view.function)
    if function not in functions:
        raise QueryError(f"unsupported aggregate {view.function}")
    return vertices.groupBy(*view.group_by).agg(functions[function].alias("value"))


def analytics(graph: PropertyGraph, view: Analytics) -> DataFrame:
    """A row for each vertex, or one row, by algorithm."""
    given = dict(view.parameters)
    spark = graph.vertices.sparkSession
    one = lambda value, kind="double": spark.createDataFrame([(value,)], f"value {kind}")
    whole = PropertyGraph(traverse.known_ids(graph), graph.edges)
    name = view.algorithm
    if name == "pagerank":
        return algorithms.pagerank(whole, given.get("damping", 0.85), given.get("iterations", 10), None, simple=True).scores
    if name in ("connectivity", "connected_components"):
        found = algorithms.connected_components(graph)
        return found if name == "connected_components" else found.agg(F.countDistinct("component").alias("value"))
    if name == "strongly_connected":
        return algorithms.strongly_connected(graph)
    if name == "shortest_path":
        found = algorithms.shortest_distances(graph, given["source"], target=given["target"])
        row = found.where(F.col("id") == given["target"]).first()
        return one(row["distance"] if row else float("inf"))
    if name == "path_exists":
        return one(algorithms.path_exists(graph, given["source"], given["target"]), "boolean")
    if name == "degree_centrality":
        return algorithms.degree_centrality(whole)
    if name == "closeness":
        return algorithms.closeness(whole)
    if name == "betweenness":
        return algorithms.betweenness(graph)
    if name == "eigenvector":
        return algorithms.eigenvector(whole, given.get("iterations", 100), given.get("tolerance", 1e-6)).scores
    if name == "all_paths":
        return shapes.all_paths(graph, given["source"], given["target"], given.get("max_depth", 5))
    if name == "triangle_count":
        return algorithms.triangles(graph).agg(F.count("*").alias("value"))
    if name == "clustering_coefficient":
        return algorithms.clustering(whole)
    if name == "k_core":
        return algorithms.k_core(graph, given.get("k", 2))
    raise QueryError(f"unsupported algorithm {name}")


def compute(graph: PropertyGraph, kind: Any) -> DataFrame | tuple[DataFrame, ...]:
    """The rows of a view of this kind on this graph; a tuple for a hybrid's parts."""
    if isinstance(kind, Lookup):
        return graph.vertices.where(F.col("id").isin(list(kind.keys))) if kind.keys else graph.vertices
    if isinstance(kind, Aggregation):
        return aggregate(graph.vertices, kind)
    if isinstance(kind, Analytics):
        return analytics(graph, kind)
    if isinstance(kind, SqlQuery):
        return sqlviews.run(graph, kind.text)
    if isinstance(kind, Hybrid):
        return tuple(compute(graph, p) for p in parts_of(kind))
    raise TypeError(f"not a view: {kind!r}")


def fingerprint(kind: Any) -> str:
    """The same for equal definitions, in every process."""
    return hashlib.sha256(json.dumps(to_json(kind), sort_keys=True).encode()).hexdigest()[:16]


def to_json(kind: Any) -> dict:
    if isinstance(kind, Hybrid):
        return {"kind": "Hybrid", "parts": [to_json(p) for p in kind.parts]}
    return {"kind": type(kind).__name__, **{k: list(v) if isinstance(v, tuple) else v for k, v in asdict(kind).items()}}


def from_json(data: dict) -> Any:
    data = dict(data)
    kind = KINDS[data.pop("kind")]
    if kind is Hybrid:
        return Hybrid(tuple(from_json(p) for p in data["parts"]))
    return kind(**{k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in data.items()})


class Registry:
    """View definitions as JSON files and view data as Parquet, in one folder.

    Definitions are small and read by the driver; data is written and read by
    Spark, so ``data_dir`` may be any URI.
    """

    def __init__(self, path: str, data_dir: str | None = None, clock: Callable[[], float] = time.time):
        self.path, self.data_dir, self.clock = path, data_dir or f"{path}/data", clock
        self.views: dict[str, View] = {}

    def register(self, view: View) -> View:
        if view.name in self.views:
            raise ValueError(f"view {view.name} exists")
        view.validate()
        self.views[view.name] = view
        self._write(view)
        return view

    def get(self, name: str) -> View:
        return self.views[name]

    def list(self) -> list[View]:
        return [self.views[n] for n in sorted(self.views)]

    def delete(self, name: str) -> None:
        del self.views[name]
        os.remove(self._file(name))

    def load(self) -> int:
        """Read every definition in the folder; the number read."""
        if not os.path.isdir(self.path):
            return 0
        names = sorted(n for n in os.listdir(self.path) if n.endswith(".json"))
        for name in names:
            with open(f"{self.path}/{name}") as file:
                data = json.load(file)
            view = View(data["name"], from_json(data["kind"]), Refresh(**data["refresh"]), data["memory_mb"], data["refreshed"], tuple(data["reads"]))
            self.views[view.name] = view
        return len(names)

    def _file(self, name: str) -> str:
        return f"{self.path}/{name}.json"

    def _write(self, view: View) -> None:
        os.makedirs(self.path, exist_ok=True)
        data = {"name": view.name, "kind": to_json(view.kind), "refresh": asdict(view.refresh), "memory_mb": view.memory_mb, "refreshed": view.refreshed, "reads": list(view.reads)}
        with open(f"{self._file(view.name)}.new", "w") as file:
            json.dump(data, file, indent=2, sort_keys=True)
        os.replace(f"{self._file(view.name)}.new", self._file(view.name))

    def refresh(self, name: str, graph: PropertyGraph) -> None:
        """Compute a view afresh and keep its rows."""
        view = self.views[name]
        found = compute(graph, view.kind)
        for k, df in enumerate(found if isinstance(found, tuple) else (found,)):
            df.write.mode("overwrite").parquet(f"{self.data_dir}/{name}/{k}")
        view.refreshed = self.clock()
        self._write(view)

    def refresh_due(self, graph: PropertyGraph) -> list[str]:
        due = [v.name for v in self.list() if v.needs_refresh(self.clock())]
        for name in due:
            self.refresh(name, graph)
        return due

    def data(self, spark: SparkSession, name: str) -> DataFrame | tuple[DataFrame, ...]:
        parts = parts_of(self.views[name].kind)
        found = tuple(spark.read.parquet(f"{self.data_dir}/{name}/{k}") for k in range(len(parts)))
        return found if isinstance(self.views[name].kind, Hybrid) else found[0]
