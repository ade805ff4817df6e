"""Shapes in a graph: cycles, stars, paths and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph
from graphloom.sources.shared import saved

from .algorithms import connected_components
from .traverse import undirected


def simple_paths(graph: PropertyGraph, length: int, starts: DataFrame | None = None) -> DataFrame:
    """``path``: the vertices of every directed path of ``length`` edges that visits none twice.

    ``starts (id)`` limits the first vertex.  There are as many rows as paths.
    """
    edges = saved(graph.edges.where("src <> dst").select("src", "dst").distinct(), "paths")
    first = edges if starts is None else edges.join(starts.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    found = first.select(F.array("src", "dst").alias("path"), F.col("dst").alias("at"))
    for _ in range(length - 1):
        found = _longer(found, edges)
    return found.select("path")


def _longer(found: DataFrame, edges: DataFrame) -> DataFrame:
    step = found.join(edges, found["at"] == edges["src"]).where(~F.array_contains("path", F.col("dst")))
    return step.select(F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("at"))


def all_paths(graph: PropertyGraph, start: int, end: int, max_depth: int) -> DataFrame:
    """``path, hops``: every directed path from ``start`` to ``end`` of at most ``max_depth`` edges that visits no vertex twice."""
    spark = graph.edges.sparkSession
    edges = saved(graph.edges.where("src <> dst").select("src", "dst").distinct(), "paths")
    at = spark.createDataFrame([([start], start)], "path array<long>, at long")
    found = at.where(F.col("at") == end)
    for _ in range(max_depth):
        at = saved(_longer(at.where(F.col("at") != end), edges), "paths")
        if at.isEmpty():
            break
        found = found.unionByName(at.where(F.col("at") == end))
    return found.select("path", (F.size("path") - 1).alias("hops"))


def cycles(graph: PropertyGraph, length: int) -> DataFrame:
    """``cycle``: every directed cycle of ``length`` edges once, its least vertex first; a loop has length 1."""
    pairs = graph.edges.select("src", "dst").distinct()
    if length == 1:
        return pairs.where("src = dst").select(F.array("src").alias("cycle"))
    edges = saved(pairs.where("src <> dst"), "cycles")
    # a path that falls below its first vertex is found from there
    found = edges.where("src < dst").select(F.array("src", "dst").alias("path"), F.col("dst").alias("at"))
    for _ in range(length - 2):
        found = _longer(found, edges).where(F.col("at") > F.col("path")[0])
    closing = edges.select(F.col("src").alias("at"), F.col("dst").alias("first"))
    return found.withColumn("first", F.col("path")[0]).join(closing, ["at", "first"], "left_semi").select(F.col("path").alias("cycle"))


def stars(graph: PropertyGraph, least: int) -> DataFrame:
    """``id, arms``: vertices with at least ``least`` distinct neighbours, direction ignored."""
    return undirected(graph.edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("arms")).where(F.col("arms") >= least)


def communities(graph: PropertyGraph, least: int = 1) -> DataFrame:
    """``component, members``: connected components of at least ``least`` vertices."""
    return connected_components(graph).groupBy("component").agg(F.count("*").alias("members")).where(F.col("members") >= least)
