"""Changes to a graph as rows, and folding them into its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.model import EDGE_KEY, PropertyGraph

#: Fixed names of the six operations.
ADD_VERTEX, REMOVE_VERTEX, UPDATE_VERTEX = "add_vertex", "remove_vertex", "update_vertex"
ADD_EDGE, REMOVE_EDGE, UPDATE_EDGE = "add_edge", "remove_edge", "update_edge"
VERTEX_OPS, EDGE_OPS = (ADD_VERTEX, REMOVE_VERTEX, UPDATE_VERTEX), (ADD_EDGE, REMOVE_EDGE, UPDATE_EDGE)
SCHEMA = "seq long, changeset_id string, source string, op string, id long, src long, dst long, label string, before map<string,string>, after map<string,string>"


def latest(changes: DataFrame, *keys: str) -> DataFrame:
    """The last change of each key, by ``seq``: aggregated before the shuffle, no sort of a key's history."""
    others = [c for c in changes.columns if c not in keys]
    packed = F.max(F.struct(F.col("seq"), *(F.col(c) for c in others if c != "seq" and c not in ("before", "after")), F.to_json("after").alias("_after")))
    folded = changes.groupBy(*keys).agg(packed.alias("c"))
    picked = [F.col(f"c.{c}").alias(c) for c in others if c not in ("before", "after")]
    return folded.select(*keys, *picked, F.from_json("c._after", "map<string,string>").alias("after"))


def typed(after: Column, df: DataFrame, skip: tuple[str, ...]) -> list[Column]:
    """The property columns of ``df`` out of a map of texts; what the map lacks is null."""
    return [F.try_element_at(after, F.lit(f.name)).cast(f.dataType).alias(f.name) for f in df.schema if f.name not in skip]


def fold(graph: PropertyGraph, changes: DataFrame, ops: set[str] | None = None) -> PropertyGraph:
    """The graph after all changes, in the order of ``seq``.

    ``ops``, where known, names the operations that occur: a table that none
    of them touches is passed through, and edges' histories are only read if
    some edge has one.

    Adding a vertex or an edge again replaces its properties.  Removing a
    vertex removes its edges at that moment; later edges stay.  Updating a
    vertex that is not there adds it, updating such an edge does nothing.
    """
    ops = {*VERTEX_OPS, *EDGE_OPS} if ops is None else ops
    vertices = _fold_vertices(graph, changes) if ops & set(VERTEX_OPS) else graph.vertices
    if ops & set(EDGE_OPS):
        return PropertyGraph(vertices, _fold_edges(graph, changes))
    if REMOVE_VERTEX not in ops:
        return PropertyGraph(vertices, graph.edges)
    edges, gone = graph.edges, changes.where(F.col("op") == REMOVE_VERTEX).select("id").distinct()
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return PropertyGraph(vertices, edges.select(*graph.edges.columns))


def _fold_vertices(graph: PropertyGraph, changes: DataFrame) -> DataFrame:
    columns = graph.vertices.columns
    last = latest(changes.where(F.col("op").isin(*VERTEX_OPS)).select("seq", "op", "id", "before", "after"), "id")
    kept = graph.vertices.join(last.select("id"), "id", "left_anti").select(*columns)
    put = last.where(F.col("op") != REMOVE_VERTEX).select("id", *typed(F.col("after"), graph.vertices, ("id",)))
    return kept.unionByName(put.select(*columns))


def _fold_edges(graph: PropertyGraph, changes: DataFrame) -> DataFrame:
    columns = graph.edges.columns
    removed = changes.where(F.col("op") == REMOVE_VERTEX).groupBy("id").agg(F.max("seq").alias("gone"))
    gone = [removed.select(F.col("id").alias(end), F.col("gone").alias(f"gone_{end}")) for end in ("src", "dst")]
    log = changes.where(F.col("op").isin(*EDGE_OPS)).select("seq", "op", *EDGE_KEY, "after")
    # an edge exists from its last addition after every removal of it or of an end
    base = graph.edges.select(*EDGE_KEY).withColumn("seq", F.lit(-1).cast("long")).withColumn("op", F.lit(ADD_EDGE)).withColumn("after", F.lit(None).cast("map<string,string>"))
    touched = log.select(*EDGE_KEY).distinct()
    # untouched edges only lose those whose ends went
    still = graph.edges
    for end, rows in zip(("src", "dst"), gone):
        still = still.join(rows.select(end), end, "left_anti")
    still = still.select(*columns).join(touched, list(EDGE_KEY), "left_anti").select(*columns)
    history = log.unionByName(base.join(touched, list(EDGE_KEY), "left_semi"))
    for end, rows in zip(("src", "dst"), gone):
        history = history.join(rows, end, "left")
    bound = F.greatest(F.coalesce("gone_src", F.lit(-2).cast("long")), F.coalesce("gone_dst", F.lit(-2).cast("long")))
    by_key = Window.partitionBy(*EDGE_KEY).orderBy("seq")
    alive = F.last(F.when((F.col("op") == ADD_EDGE) & (F.col("seq") > F.col("bound")), F.lit(True)).when((F.col("op") == REMOVE_EDGE) | (F.col("seq") <= F.col("bound")), F.lit(False)), True)
    marked = history.withColumn("bound", bound).where("seq > bound").withColumn("alive", alive.over(by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # an update without an edge is not part of its history
    real = marked.where((F.col("op") != UPDATE_EDGE) | F.coalesce("alive", F.lit(False)))
    final = real.withColumn("n", F.row_number().over(Window.partitionBy(*EDGE_KEY).orderBy(F.desc("seq")))).where((F.col("n") == 1) & (F.col("op") != REMOVE_EDGE))
    changed = final.where("seq >= 0").select(*EDGE_KEY, *typed(F.col("after"), graph.edges, EDGE_KEY)).select(*columns)
    same = graph.edges.join(final.where("seq < 0").select(*EDGE_KEY), list(EDGE_KEY), "left_semi").select(*columns)
    return still.unionByName(same).unionByName(changed)


def as_changes(spark, rows: list[dict]) -> DataFrame:
    """A change table from operations as dicts; property values become texts."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    text = lambda m: None if m is None else {k: _text(v) for k, v in m.items() if v is not None}
    made = [{**dict.fromkeys(names), **r, "before": text(r.get("before")), "after": text(r.get("after"))} for r in rows]
    return spark.createDataFrame([tuple(m[n] for n in names) for m in made], SCHEMA)


def _text(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)
