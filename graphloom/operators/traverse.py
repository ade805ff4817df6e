"""Neighbours, hops, degrees and whole-graph measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph, endpoints, reversed_edges
from graphloom.sources.shared import saved

KEEP_EVERY = 4


def out_neighbors(graph: PropertyGraph, vertex: int, label: str | None = None) -> DataFrame:
    """Edges that leave ``vertex``, with ``neighbor``; one hop along ``label`` if given."""
    found = graph.edges.where(F.col("src") == vertex)
    return _labelled(found, label).withColumn("neighbor", F.col("dst"))


def in_neighbors(graph: PropertyGraph, vertex: int, label: str | None = None) -> DataFrame:
    found = graph.edges.where(F.col("dst") == vertex)
    return _labelled(found, label).withColumn("neighbor", F.col("src"))


def all_neighbors(graph: PropertyGraph, vertex: int, label: str | None = None) -> DataFrame:
    """Outgoing and incoming edges; an edge to itself comes twice."""
    return out_neighbors(graph, vertex, label).unionByName(in_neighbors(graph, vertex, label))


def neighbor_ids(graph: PropertyGraph, vertex: int, direction: str = "both") -> DataFrame:
    """Distinct ids next to ``vertex``: ``out``, ``in`` or ``both``."""
    by = {"out": out_neighbors, "in": in_neighbors, "both": all_neighbors}[direction]
    return by(graph, vertex).select(F.col("neighbor").alias("id")).distinct()


def two_hop(graph: PropertyGraph, start: int, label: str | None = None) -> DataFrame:
    """Distinct ids two outgoing edges away, ``start`` left out, direct neighbours not."""
    edges = _labelled(graph.edges, label).select("src", "dst")
    first = edges.where(F.col("src") == start).select(F.col("dst").alias("via")).distinct()
    return edges.join(first, edges["src"] == first["via"]).select(F.col("dst").alias("id")).where(F.col("id") != start).distinct()


def two_hop_pairs(graph: PropertyGraph, label: str | None = None) -> DataFrame:
    """For every start its distinct ids two edges away."""
    edges = _labelled(graph.edges, label).select("src", "dst").distinct()
    second = edges.select(F.col("src").alias("via"), F.col("dst").alias("id"))
    return edges.join(second, edges["dst"] == second["via"]).where("src <> id").select(F.col("src").alias("start"), "id").distinct()


def edges_between(graph: PropertyGraph, a: int, b: int) -> DataFrame:
    """Edges from one to the other, either way."""
    there = (F.col("src") == a) & (F.col("dst") == b)
    return graph.edges.where(there | (F.col("src") == b) & (F.col("dst") == a))


def degrees(graph: PropertyGraph) -> DataFrame:
    """``id, out_degree, in_degree, degree`` of every listed vertex; parallel labels count apart."""
    ends = graph.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    counted = ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return graph.vertices.select("id").join(counted, "id", "left").select("id", zero("out_degree"), zero("in_degree")).withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def most_connected(graph: PropertyGraph) -> DataFrame:
    """All vertices tied for the largest degree."""
    found = saved(degrees(graph).select("id", "degree"), "degrees")
    most = found.agg(F.max("degree").alias("degree"))
    return found.join(F.broadcast(most), "degree", "left_semi").select("id", "degree")


def density(graph: PropertyGraph) -> DataFrame:
    """One row: ``vertices, edges, density`` = E / (V (V - 1)), 0 for fewer than two vertices."""
    v = F.col("vertices")
    return _sizes(graph).withColumn("density", F.when(v > 1, F.col("edges") / (v * (v - 1))).otherwise(F.lit(0.0)))


def average_degree(graph: PropertyGraph) -> DataFrame:
    """One row: ``average_degree`` = 2 E / V."""
    v = F.col("vertices")
    return _sizes(graph).select(F.when(v > 0, 2.0 * F.col("edges") / v).otherwise(F.lit(0.0)).alias("average_degree"))


def _sizes(graph: PropertyGraph) -> DataFrame:
    both = graph.vertices.select(F.lit(1).alias("v"), F.lit(0).alias("e")).unionByName(graph.edges.select(F.lit(0).alias("v"), F.lit(1).alias("e")))
    return both.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("vertices"), F.coalesce(F.sum("e"), F.lit(0)).alias("edges"))


def label_histogram(graph: PropertyGraph) -> DataFrame:
    return graph.edges.groupBy("label").agg(F.count("*").alias("edges"))


def adjacency_matrix(graph: PropertyGraph, ids: list[int], weight: str = "weight") -> DataFrame:
    """Weights among ``ids`` as a dense table: a row for each, a column named by each; 0 without an edge."""
    inside = graph.edges.where(F.col("src").isin(ids) & F.col("dst").isin(ids))
    wide = inside.groupBy("src").pivot("dst", ids).agg(F.sum(weight) if weight in graph.edges.columns else F.count("*").cast("double"))
    rows = graph.edges.sparkSession.createDataFrame([(i,) for i in ids], "src long")
    return rows.join(wide, "src", "left").fillna(0.0)


def shortest_path(graph: PropertyGraph, start: int, end: int, max_depth: int, label: str | None = None) -> list[int] | None:
    """A path of fewest outgoing edges, at most ``max_depth``; the least by ids among those.

    The frontier holds one path for each vertex reached, the least, so it
    never exceeds the vertices.
    """
    if start == end:
        return [start]
    spark = graph.edges.sparkSession
    edges = _labelled(graph.edges, label).select("src", "dst").distinct()
    frontier = spark.createDataFrame([(start, [start])], "id long, path array<long>")
    known = frontier.select("id")
    for depth in range(1, max_depth + 1):
        step = edges.join(frontier, edges["src"] == frontier["id"]).select("dst", "path")
        step = step.join(known.withColumnRenamed("id", "dst"), "dst", "left_anti")
        reached = step.groupBy(F.col("dst").alias("id")).agg(F.min("path").alias("path"))
        frontier = saved(reached.select("id", F.concat("path", F.array("id")).alias("path")), "frontier")
        found = frontier.where(F.col("id") == end).first()
        if found:
            return list(found["path"])
        if frontier.isEmpty():
            return None
        known = known.unionByName(frontier.select("id"))
    return None


def common_neighbors(graph: PropertyGraph) -> DataFrame:
    """``a, b, common``: unlinked pairs a < b and how many neighbours they share, direction ignored.

    Wedges are counted by their middle vertex, so a middle of degree d makes d * (d - 1) / 2 rows.
    """
    either = undirected(graph.edges)
    right = either.select(F.col("a").alias("m"), F.col("b").alias("d"))
    wedges = either.join(right, either["a"] == right["m"]).where("b < d").groupBy(F.col("b").alias("a"), F.col("d").alias("b")).agg(F.count("*").alias("common"))
    return wedges.join(either, ["a", "b"], "left_anti")


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct linked pairs ``a, b`` in both orders, without loops."""
    pairs = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return pairs.unionByName(reversed_edges(edges.select("src", "dst")).toDF("a", "b")).where("a <> b").distinct()


def known_ids(graph: PropertyGraph) -> DataFrame:
    """Listed vertices and those that only edges name."""
    return graph.vertices.select("id").unionByName(endpoints(graph.edges)).distinct()


def _labelled(edges: DataFrame, label: str | None) -> DataFrame:
    return edges if label is None else edges.where(F.col("label") == label)
