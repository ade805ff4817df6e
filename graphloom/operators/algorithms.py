"""Iterative graph algorithms: each round is a few joins and aggregates, kept in the shared folder."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph
from graphloom.sources.shared import saved

from . import sweeps
from .components import star_roots
from .traverse import degrees, known_ids, undirected

KEEP_EVERY = 5
MAX_ROUNDS = 10_000
SAME_COST = 1e-9


@dataclass
class Ranks:
    scores: DataFrame  # id, score
    iterations: int
    delta: float

    def top(self, n: int) -> DataFrame:
        return self.scores.orderBy(F.desc("score"), "id").limit(n)

    def score(self, vertex: int) -> float | None:
        row = self.scores.where(F.col("id") == vertex).first()
        return row["score"] if row else None


def pagerank(graph: PropertyGraph, damping: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-6, normalized: bool = True, simple: bool = False) -> Ranks:
    """PageRank over the listed vertices.

    ``normalized``: start at 1/n with base (1 - d)/n, else at 1 with base
    1 - d.  Parallel edges count each (``simple``: once).  Dangling mass is
    lost, edges from unlisted sources add nothing, edges to unlisted targets
    still count in the source's degree.  Ends when no score moves by
    ``tolerance``; None runs all ``iterations`` without looking.
    """
    ids = saved(graph.vertices.select("id"), "ranks")
    n = ids.count()
    if not n:
        return Ranks(ids.withColumn("score", F.lit(0.0)), 0, tolerance or 0.0)
    links = graph.edges.select("src", "dst")
    links = links.distinct().withColumn("times", F.lit(1)) if simple else links.groupBy("src", "dst").agg(F.count("*").alias("times"))
    out = links.groupBy("src").agg(F.sum("times").alias("out"))
    # a share for each pair, kept partitioned by source: a round moves scores, not edges
    shares = saved(links.join(out, "src").select("src", "dst", (F.col("times") / F.col("out")).alias("share")), "shares")
    shares = shares.repartition(_partitions(shares), "src").persist(StorageLevel.MEMORY_AND_DISK)
    base, first = ((1 - damping) / n, 1.0 / n) if normalized else (1 - damping, 1.0)
    scores = ids.withColumn("score", F.lit(first))
    delta, done = tolerance or 0.0, 0
    for done in range(1, iterations + 1):
        given = shares.join(scores, shares["src"] == scores["id"]).groupBy("dst").agg(F.sum(F.col("share") * F.col("score")).alias("given"))
        fresh = ids.join(given, ids["id"] == given["dst"], "left").select("id", (F.lit(base) + F.lit(damping) * F.coalesce("given", F.lit(0.0))).alias("score"))
        if tolerance is not None:
            fresh = saved(fresh, "ranks")
            before = scores.withColumnRenamed("score", "before")
            delta = fresh.join(before, "id").agg(F.max(F.abs(F.col("score") - F.col("before")))).first()[0]
        elif done % KEEP_EVERY == 0 or done == iterations:
            fresh = saved(fresh, "ranks")
        scores = fresh
        if tolerance is not None and delta < tolerance:
            break
    shares.unpersist()
    return Ranks(scores, done, delta)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def eigenvector(graph: PropertyGraph, iterations: int = 100, tolerance: float | None = 1e-6) -> Ranks:
    """Eigenvector centrality over the listed vertices, by distinct incoming edges between them.

    Power iteration on the edges and the identity, which keeps cycles from
    swinging; each round's scores have length 1.  Ends when the scores move
    by less than ``tolerance`` in all; None runs all ``iterations``.
    """
    ids = saved(graph.vertices.select("id"), "eigen")
    n = ids.count()
    if not n:
        return Ranks(ids.withColumn("score", F.lit(0.0)), 0, 0.0)
    inside = graph.edges.select("src", "dst").distinct()
    for end in ("src", "dst"):
        inside = inside.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    links = saved(inside.select("src", "dst"), "eigen")
    links = links.repartition(_partitions(links), "src").persist(StorageLevel.MEMORY_AND_DISK)
    scores = ids.withColumn("score", F.lit(1.0 / math.sqrt(n)))
    delta, done = 0.0, 0
    for done in range(1, iterations + 1):
        given = links.join(scores, links["src"] == scores["id"]).groupBy("dst").agg(F.sum("score").alias("given"))
        raw = saved(scores.join(given, scores["id"] == given["dst"], "left").select("id", F.col("score").alias("before"), (F.col("score") + F.coalesce("given", F.lit(0.0))).alias("raw")), "eigen")
        norm = math.sqrt(raw.agg(F.sum(F.col("raw") * F.col("raw"))).first()[0])
        scores = raw.select("id", (F.col("raw") / F.lit(norm)).alias("score"))
        if tolerance is not None:
            delta = raw.agg(F.sum(F.abs(F.col("raw") / F.lit(norm) - F.col("before")))).first()[0]
            if delta < tolerance:
                break
    links.unpersist()
    return Ranks(scores, done, delta)


def connected_components(graph: PropertyGraph) -> DataFrame:
    """``id, component`` of every known vertex: the least id reachable, direction ignored."""
    edges = saved(graph.edges.select("src", "dst").distinct(), "links")
    roots = star_roots(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return known_ids(PropertyGraph(graph.vertices, edges.withColumn("label", F.lit("")))).join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("component"))


def component_members(components: DataFrame, component: int) -> DataFrame:
    return components.where(F.col("component") == component).select("id")


def component_count(components: DataFrame) -> int:
    return components.select("component").distinct().count()


def shortest_distances(graph: PropertyGraph, start: int, weight: str = "weight", target: int | None = None) -> DataFrame:
    """``id, distance, via`` of every vertex reachable by outgoing edges; ``via`` precedes it on a least path.

    A missing weight counts as 1; negative ones are refused.  Rounds relax the
    vertices that became nearer, until none does or none is nearer than
    ``target``.  Of paths equal within ``SAME_COST`` (sums differ in their last
    bits by the order of their edges) ``via`` is the least.
    """
    spark = graph.edges.sparkSession
    cost = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight in graph.edges.columns else F.lit(1.0)
    edges = saved(graph.edges.groupBy("src", "dst").agg(F.min(cost).alias("cost")), "costs")
    if edges.where("cost < 0").limit(1).count():
        raise ValueError("weights must not be negative")
    known = spark.createDataFrame([(start, 0.0, None)], "id long, distance double, via long")
    frontier = known
    for _ in range(MAX_ROUNDS):
        step = edges.join(frontier, edges["src"] == frontier["id"])
        offers = step.groupBy("dst").agg(F.min(F.struct((F.col("distance") + F.col("cost")).alias("distance"), F.col("src").alias("via"))).alias("o"))
        offers = offers.select(F.col("dst").alias("id"), "o.distance", "o.via")
        if target is not None:
            bound = known.where(F.col("id") == target).agg(F.min("distance")).first()[0]
            offers = offers if bound is None else offers.where(F.col("distance") <= bound)
        both = known.withColumn("new", F.lit(0)).unionByName(offers.withColumn("new", F.lit(1)))
        best = both.groupBy("id").agg(F.min(F.struct("distance", "new", "via")).alias("b"), F.min(F.when(F.col("new") == 0, F.col("distance"))).alias("before"))
        kept = saved(best.select("id", "b.distance", "b.via", (F.col("before").isNull() | (F.col("b.distance") < F.col("before"))).alias("nearer")), "distances")
        frontier = kept.where("nearer").select("id", "distance")
        known = kept.select("id", "distance", "via")
        if frontier.isEmpty():
            break
    # equal paths: the least predecessor that attains the distance, but for rounding
    ends = known.select(F.col("id").alias("dst"), F.col("distance").alias("total"))
    tied = edges.join(known.select(F.col("id").alias("src"), "distance"), "src").join(ends, "dst").where(F.abs(F.col("distance") + F.col("cost") - F.col("total")) < SAME_COST).where(F.col("dst") != start)
    via = tied.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("via"))
    return known.select("id", "distance").join(via, "id", "left")


def path_to(distances: DataFrame, start: int, end: int) -> list[int] | None:
    """The vertices of a least path, by following ``via`` back; None if unreachable.

    Jumps of doubled length take as many rounds as the path's length has bits.
    """
    if start == end:
        return [start]
    back = saved(distances.where("via is not null").select("id", "via"), "path")
    found = back.sparkSession.createDataFrame([(end, 0)], "id long, place long")
    length, most = 1, back.count()
    while length <= 2 * most:
        more = found.join(back, "id").select(F.col("via").alias("id"), (F.col("place") + length).alias("place"))
        found = saved(found.unionByName(more), "path")
        reached = found.where(F.col("id") == start).agg(F.min("place")).first()[0]
        if reached is not None:
            rows = found.where(F.col("place") <= reached).orderBy(F.desc("place")).collect()
            return [r["id"] for r in rows]
        ahead = back.select(F.col("id").alias("via"), F.col("via").alias("next"))
        back = saved(back.join(ahead, "via").select("id", F.col("next").alias("via")), "path")
        length *= 2
    return None


def bfs_levels(graph: PropertyGraph, start: int, max_depth: int | None = None) -> DataFrame:
    """``id, hops``: fewest outgoing edges from ``start``, itself at 0."""
    spark = graph.edges.sparkSession
    edges = saved(graph.edges.select("src", "dst").distinct(), "hops")
    known = frontier = spark.createDataFrame([(start, 0)], "id long, hops int")
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = edges.join(frontier, edges["src"] == frontier["id"]).select(F.col("dst").alias("id")).distinct()
        frontier = saved(step.join(known, "id", "left_anti").withColumn("hops", F.lit(depth)), "hops")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def reachability(graph: PropertyGraph, sources: DataFrame | None = None) -> DataFrame:
    """All distinct ``u, v`` with a path of at least one edge from u to v.

    ``sources (id)`` limits u.  Strong components are found first and only
    pairs of them are closed; members are joined on at the end, so a dense
    part costs its result and not a join for each round.  The result is as
    large as the closure is.
    """
    edges = saved(graph.edges.select("src", "dst").distinct(), "closure")
    if sources is not None:
        first = edges.join(sources.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
        return _closure(first.select(F.col("src").alias("u"), F.col("dst").alias("v")), edges)
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    member = saved(strongly_connected(PropertyGraph(ids, edges.withColumn("label", F.lit("")))), "closure")
    ends = [member.select(F.col("id").alias(c), F.col("component").alias(k)) for c, k in (("src", "a"), ("dst", "b"))]
    links = saved(edges.join(ends[0], "src").join(ends[1], "dst").select("a", "b").distinct(), "closure")
    between = links.where("a <> b")
    pairs = _closure(between.select(F.col("a").alias("u"), F.col("b").alias("v")), between.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    pairs = pairs.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(links.where("a = b"))
    # a large component's members meet in as many tasks as there are salts; the salted copies are many times what
    # Spark takes their size for, so they must not be broadcast through the driver; each v meets a short run of u,
    # the same each time, which files hold in a fraction of the space that runs of all v take
    salts = _partitions(edges)
    left = pairs.join(ends[0].withColumnRenamed("src", "u"), "a").select("u", "b", F.pmod(F.xxhash64("u"), F.lit(salts)).alias("salt"))
    right = ends[1].withColumnRenamed("dst", "v").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return right.hint("merge").join(left, ["b", "salt"]).select("u", "v")


def _closure(fresh: DataFrame, edges: DataFrame) -> DataFrame:
    """Semi-naive closure of ``fresh (u, v)`` under ``edges``: only pairs new in a round are extended."""
    known = fresh
    for _ in range(MAX_ROUNDS):
        step = fresh.join(edges, fresh["v"] == edges["src"]).select("u", F.col("dst").alias("v")).distinct()
        fresh = saved(step.join(known, ["u", "v"], "left_anti"), "closure")
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh)
    raise RuntimeError("the closure did not end")


def path_exists(graph: PropertyGraph, start: int, end: int) -> bool:
    """Whether outgoing edges lead from ``start`` to ``end``."""
    return start == end or not bfs_levels(graph, start).where(F.col("id") == end).isEmpty()


def strongly_connected(graph: PropertyGraph) -> DataFrame:
    """``id, component`` of every known vertex: the least id in its strong component.

    Vertices without an incoming or outgoing edge among the open ones are
    components of their own and go first.  The others take the least id that
    reaches them as colour; those that reach their colour's vertex inside the
    colour are its component.  Repeats on the rest.  These rounds grow with
    the longest ways, so up to ``sweeps.MOST_EDGES`` edges one task, in time
    linear in them, finds all components.
    """
    open_edges = saved(graph.edges.select("src", "dst").where("src <> dst").distinct(), "strong")
    all_ids = known_ids(graph)
    done: DataFrame | None = None
    while True:
        if open_edges.count() <= sweeps.MOST_EDGES:
            found = saved(sweeps.strong_parts(open_edges), "strong")
            done = found if done is None else done.unionByName(found)
            break
        open_edges = _trimmed(open_edges)
        if open_edges.isEmpty():
            break
        colour = _spread_least(open_edges)
        inside = open_edges.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b").select("src", "dst", F.col("a").alias("colour"))
        inside = saved(inside, "strong")
        roots = colour.where("id = colour")
        found = _backward(inside, roots)
        done = found if done is None else done.unionByName(found)
        left = open_edges.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti")
        open_edges = saved(left.select("src", "dst"), "strong")
    if done is None:
        return all_ids.select("id", F.col("id").alias("component"))
    return all_ids.join(done, "id", "left").select("id", F.coalesce("colour", "id").alias("component"))


def _trimmed(edges: DataFrame) -> DataFrame:
    size = edges.count()
    while size:
        kept = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        edges = saved(kept.select("src", "dst"), "strong")
        before, size = size, edges.count()
        if size == before:
            break
    return edges


def _spread_least(edges: DataFrame) -> DataFrame:
    """The least id that reaches each vertex, itself included."""
    now = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("colour", F.col("id"))
    frontier = now = saved(now, "colours")
    for _ in range(MAX_ROUNDS):
        offers = edges.join(frontier, edges["src"] == frontier["id"]).groupBy("dst").agg(F.min("colour").alias("offer"))
        fresh = saved(now.join(offers, now["id"] == offers["dst"], "left").select("id", F.least("colour", "offer").alias("colour"), (F.coalesce(F.col("offer") < F.col("colour"), F.lit(False))).alias("moved")), "colours")
        now, frontier = fresh.select("id", "colour"), fresh.where("moved").select("id", "colour")
        if frontier.isEmpty():
            return now
    raise RuntimeError("colours did not settle")


def _backward(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Vertices that reach their colour's root along edges of the colour."""
    known = frontier = saved(roots.select("id", "colour"), "strong")
    for _ in range(MAX_ROUNDS):
        step = edges.join(frontier.select(F.col("id").alias("dst"), F.col("colour").alias("c")), "dst").where("colour = c").select(F.col("src").alias("id"), "colour").distinct()
        frontier = saved(step.join(known, ["id", "colour"], "left_anti"), "strong")
        if frontier.isEmpty():
            return known
        known = known.unionByName(frontier)
    raise RuntimeError("a strong component did not settle")


def k_core(graph: PropertyGraph, k: int) -> DataFrame:
    """Edges left when vertices with fewer than ``k`` edge ends are dropped again and again."""
    edges = saved(graph.edges, "core")
    size = edges.count()
    while size:
        ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").count().where(F.col("count") >= k).select("id")
        kept = edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
        edges = saved(kept.select(*graph.edges.columns), "core")
        before, size = size, edges.count()
        if size == before:
            break
    return edges


def triangles(graph: PropertyGraph) -> DataFrame:
    """Distinct ``a < b < c``, pairwise linked in either direction.

    Each pair points from its end of lower degree, so a hub starts few wedges.
    """
    pairs = undirected(graph.edges)
    degree = pairs.groupBy("a").agg(F.count("*").alias("d"))
    ranked = pairs.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("e")), "b")
    up = saved(ranked.where("d < e or (d = e and a < b)").select("a", "b"), "oriented")
    second = up.select(F.col("a").alias("m"), F.col("b").alias("c"))
    wedges = up.join(second, up["a"] == second["m"]).where("b < c").select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("c").alias("z"))
    closing = up.select(F.least("a", "b").alias("y"), F.greatest("a", "b").alias("z"))
    found = wedges.join(closing, ["y", "z"]).select(F.array_sort(F.array("x", "y", "z")).alias("t"))
    return found.select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))


def clustering(graph: PropertyGraph) -> DataFrame:
    """``id, triangles, coefficient`` of every listed vertex: linked share of its neighbour pairs."""
    near = undirected(graph.edges).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"))
    own = triangles(graph).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    both = graph.vertices.select("id").join(near, "id", "left").join(own, "id", "left")
    t, n = F.coalesce("triangles", F.lit(0).cast("long")), F.coalesce("n", F.lit(0).cast("long"))
    return both.select("id", t.alias("triangles"), F.when(n > 1, 2.0 * t / (n * (n - 1))).otherwise(F.lit(0.0)).alias("coefficient"))


def degree_centrality(graph: PropertyGraph) -> DataFrame:
    """``id, centrality``: distinct out- and in-neighbours over 2 (n - 1); 0 where n < 2."""
    n = graph.vertices.count()
    own = degrees(PropertyGraph(graph.vertices, graph.edges.dropDuplicates(["src", "dst"])))
    return own.select("id", (F.col("degree") / (2.0 * (n - 1)) if n > 1 else F.lit(0.0)).alias("centrality"))


def closeness(graph: PropertyGraph, sources: DataFrame | None = None) -> DataFrame:
    """``id, closeness``: reached vertices over the hops to them, from every vertex or from ``sources``.

    Tasks that hold all edges sweep from their sources.  Where the edges are
    more than ``sweeps.MOST_EDGES``, one frontier of (source, vertex) pairs is
    joined on instead, for all sources at once.
    """
    ids = (sources if sources is not None else graph.vertices).select("id").distinct()
    edges = saved(graph.edges.select("src", "dst").distinct(), "hops")
    if edges.count() <= sweeps.MOST_EDGES:
        return _closeness_of(sweeps.hop_sums(edges, ids))
    known = frontier = saved(ids.select(F.col("id").alias("s"), "id").withColumn("hops", F.lit(0)), "hops")
    for depth in range(1, MAX_ROUNDS):
        step = edges.join(frontier, edges["src"] == frontier["id"]).select("s", F.col("dst").alias("id")).distinct()
        frontier = saved(step.join(known, ["s", "id"], "left_anti").withColumn("hops", F.lit(depth)), "hops")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    sums = known.groupBy(F.col("s").alias("id")).agg(F.sum("hops").alias("far"), F.sum(F.when(F.col("hops") > 0, 1).otherwise(0)).alias("n"))
    return _closeness_of(sums)


def _closeness_of(sums: DataFrame) -> DataFrame:
    return sums.select("id", F.when(F.col("far") > 0, F.col("n") / F.col("far")).otherwise(F.lit(0.0)).alias("closeness"))


def betweenness(graph: PropertyGraph, sources: DataFrame | None = None) -> DataFrame:
    """``id, betweenness`` of every known vertex: the share of shortest paths, by fewest edges, that pass through it.

    Ordered pairs of ends count each; a path's ends don't.  ``sources (id)``
    limits where paths begin.  Tasks that hold all edges take a source after
    another.  Where the edges are more than ``sweeps.MOST_EDGES``, all sources
    advance together by joins: a forward round counts the paths to the next
    level, a backward one hands each vertex's share to those before it, and
    rows are (source, vertex) pairs.
    """
    ids = saved(known_ids(graph), "between")
    begin = ids if sources is None else sources.select("id").distinct()
    edges = saved(graph.edges.where("src <> dst").select("src", "dst").distinct(), "between")
    if edges.count() <= sweeps.MOST_EDGES:
        shares = ids.withColumn("share", F.lit(0.0)).unionByName(sweeps.path_shares(edges, begin))
        return shares.groupBy("id").agg(F.sum("share").alias("betweenness"))
    level = saved(begin.select(F.col("id").alias("s"), "id").withColumn("paths", F.lit(1.0)), "between")
    levels, known = [level], level.select("s", "id")
    for _ in range(MAX_ROUNDS):
        step = edges.join(level, edges["src"] == level["id"]).groupBy("s", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
        level = saved(step.join(known, ["s", "id"], "left_anti"), "between")
        if level.isEmpty():
            break
        levels.append(level)
        known = known.unionByName(level.select("s", "id"))
    parts, share = [], None
    for k in range(len(levels) - 1, 0, -1):
        far = levels[k].withColumn("share", F.lit(0.0)) if share is None else levels[k].join(share, ["s", "id"], "left").fillna(0.0, ["share"])
        back = far.select("s", F.col("id").alias("dst"), ((1.0 + F.col("share")) / F.col("paths")).alias("each")).join(edges, "dst")
        near = levels[k - 1].select("s", F.col("id").alias("src"), "paths")
        share = saved(back.join(near, ["s", "src"]).groupBy("s", F.col("src").alias("id")).agg(F.sum(F.col("paths") * F.col("each")).alias("share")), "between")
        if k > 1:  # level 0 holds the sources themselves
            parts.append(share)
    total = ids.withColumn("share", F.lit(0.0))
    for part in parts:
        total = total.unionByName(part.select("id", "share"))
    return total.groupBy("id").agg(F.sum("share").alias("betweenness"))
