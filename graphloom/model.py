"""The property graph: one DataFrame of vertices and one of edges, with typed property columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERTEX_KEY = ("id",)
EDGE_KEY = ("src", "dst", "label")


@dataclass(frozen=True)
class PropertyGraph:
    """``vertices (id, type, properties...)`` and ``edges (src, dst, label, properties...)``.

    A vertex's label is its string property ``type``.  An edge is known by
    ``(src, dst, label)``; parallel edges differ in label.  A property that a
    row lacks and one that is null are the same.
    """

    vertices: DataFrame
    edges: DataFrame

    def __post_init__(self) -> None:
        for df, names, what in ((self.vertices, VERTEX_KEY, "vertices"), (self.edges, EDGE_KEY, "edges")):
            missing = [n for n in names if n not in df.columns]
            if missing:
                raise ValueError(f"{what} lack {', '.join(missing)}")

    @classmethod
    def of(cls, vertices: DataFrame, edges: DataFrame) -> PropertyGraph:
        """A graph with ids as longs, a ``type`` column and one row for each key."""
        if "type" not in vertices.columns:
            vertices = vertices.withColumn("type", F.lit(None).cast("string"))
        if "label" not in edges.columns:
            edges = edges.withColumn("label", F.lit("related"))
        vertices = vertices.withColumn("id", F.col("id").cast("long")).dropDuplicates(list(VERTEX_KEY))
        edges = edges.withColumns({c: F.col(c).cast("long") for c in ("src", "dst")}).dropDuplicates(list(EDGE_KEY))
        return cls(vertices, edges)

    def vertex_properties(self) -> list[str]:
        return [c for c in self.vertices.columns if c not in VERTEX_KEY]

    def edge_properties(self) -> list[str]:
        return [c for c in self.edges.columns if c not in EDGE_KEY]

    # scans and point reads: equality filters that reach the Parquet scan

    def vertex(self, vertex_id: int) -> DataFrame:
        return self.vertices.where(F.col("id") == vertex_id)

    def edge(self, src: int, dst: int, label: str | None = None) -> DataFrame:
        """The edge of that label, or the least label's if none is asked for."""
        found = self.edges.where((F.col("src") == src) & (F.col("dst") == dst))
        return found.orderBy("label").limit(1) if label is None else found.where(F.col("label") == label)

    def vertices_where(self, *conditions: Column, **equal) -> DataFrame:
        return self.vertices.where(_all(conditions, equal))

    def edges_where(self, *conditions: Column, **equal) -> DataFrame:
        return self.edges.where(_all(conditions, equal))

    def labelled(self, label: str) -> DataFrame:
        return self.vertices.where(F.col("type") == label)

    def edges_labelled(self, label: str) -> DataFrame:
        return self.edges.where(F.col("label") == label)

    def counts(self) -> dict[str, int]:
        return {"vertices": self.vertices.count(), "edges": self.edges.count()}

    def as_views(self) -> None:
        """Register both tables, under plural and singular names."""
        for name in ("vertices", "vertex"):
            self.vertices.createOrReplaceTempView(name)
        for name in ("edges", "edge"):
            self.edges.createOrReplaceTempView(name)


def _all(conditions: tuple[Column, ...], equal: dict) -> Column:
    return reduce(lambda a, b: a & b, [*conditions, *(F.col(k) == v for k, v in equal.items())], F.lit(True))


def endpoints(edges: DataFrame) -> DataFrame:
    """Every id that an edge names, once."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def reversed_edges(edges: DataFrame) -> DataFrame:
    """Each edge turned round; label and properties stay."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)
