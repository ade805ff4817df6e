"""The commands of a graph service as Python calls."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph
from graphloom.operators import algorithms, traverse
from graphloom.plans import matching, sqlviews
from graphloom.plans.router import Router, ViewCache
from graphloom.plans.views import Registry, View


@dataclass
class GraphService:
    """Users, relationships, influence, communities, recommendations and views over one graph."""

    graph: PropertyGraph
    registry: Registry
    router: Router = field(default_factory=Router)
    cache: ViewCache = field(default_factory=ViewCache)

    def user(self, vertex: int) -> DataFrame:
        return self.graph.vertex(vertex)

    def relationships(self, vertex: int) -> DataFrame:
        return traverse.all_neighbors(self.graph, vertex)

    def influence(self, n: int) -> DataFrame:
        """The ``n`` highest PageRank scores with their rank."""
        top = algorithms.pagerank(self.graph).top(n).collect()
        return self.graph.vertices.sparkSession.createDataFrame([(k, r["id"], r["score"]) for k, r in enumerate(top, 1)], "rank int, id long, score double")

    def communities(self) -> DataFrame:
        return algorithms.connected_components(self.graph)

    def recommendations(self, vertex: int, n: int) -> DataFrame:
        """The ``n`` unlinked vertices that share most neighbours with ``vertex``."""
        near = traverse.neighbor_ids(self.graph, vertex).withColumnRenamed("id", "via")
        either = traverse.undirected(self.graph.edges)
        shared = either.join(near, either["a"] == near["via"]).where(F.col("b") != vertex).groupBy(F.col("b").alias("id")).agg(F.count("*").alias("common"))
        return shared.join(near.withColumnRenamed("via", "id"), "id", "left_anti").orderBy(F.desc("common"), "id").limit(n)

    def stats(self) -> dict[str, Any]:
        return {**self.graph.counts(), "density": traverse.density(self.graph).first()["density"], "views": len(self.registry.views)}

    def run(self, command: str) -> Any:
        """STATS, VIEW LIST, VIEW REFRESH name, CACHE STATS, CACHE CLEAR, CACHE WARM, SQL ..., or a MATCH."""
        words = command.strip().split()
        head = [w.upper() for w in words[:2]]
        if head[:1] == ["STATS"]:
            return self.stats()
        if head == ["VIEW", "LIST"]:
            return [v.name for v in self.registry.list()]
        if head == ["VIEW", "REFRESH"]:
            return self.registry.refresh(words[2], self.graph)
        if head == ["CACHE", "STATS"]:
            return self.cache.stats()
        if head == ["CACHE", "CLEAR"]:
            return self.cache.clear()
        if head == ["CACHE", "WARM"]:
            return self.router.warm(sorted(self.router.views), self.cache, self.view_rows)
        if head[:1] == ["SQL"]:
            return sqlviews.run(self.graph, command.strip()[3:])
        return matching.query(self.graph, command)

    def create_view(self, view: View) -> None:
        self.registry.register(view)
        self.registry.refresh(view.name, self.graph)
        self.router.add(view)

    def view_rows(self, name: str) -> Any:
        return self.registry.data(self.graph.vertices.sparkSession, name)

    def answer(self, pattern: Any) -> Any:
        """A pattern's rows by the best view."""
        return self.router.execute(pattern, self.cache, self.view_rows)
