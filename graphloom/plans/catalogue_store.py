"""Queries over shapes, centralities, edge changes, the store and more kinds of maintained views, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph
from graphloom.operators import algorithms as A
from graphloom.operators import shapes
from graphloom.operators import traverse as V
from graphloom.service import GraphService
from graphloom.sources.changelog import SCHEMA, fold
from graphloom.sources.shared import new_dir
from graphloom.sources.store import GraphStore
from graphloom.sources.tables import event_graph, read, star_graph

from . import maintenance, views
from .catalogue import CUSTOMER, DIGITS, EVENT_E, NATION, ORDER, REGION, STAR_E, STAR_V, UNDIRECTED, events, on_star, register, rounded, star
from .catalogue_views import FOLDED, customers, order_changes

# reads

register("one_hop_labelled", star(lambda g: V.out_neighbors(g, ORDER + 7, "contains").select("neighbor", "weight")), f"WITH {STAR_E} SELECT dst AS neighbor, weight FROM e WHERE src = {ORDER + 7} AND label = 'contains'")
register("two_hop_labelled", events(lambda g: V.two_hop_pairs(g, "signup")), f"WITH {EVENT_E} SELECT DISTINCT a.src AS start, b.dst AS id FROM e a JOIN e b ON a.dst = b.src WHERE a.label = 'signup' AND b.label = 'signup' AND a.src <> b.dst")
register("edge_point_read_labelled", star(lambda g: g.edge(NATION + 2, REGION + 2, "in_region").select("src", "dst", "label")), f"WITH {STAR_E} SELECT src, dst, label FROM e WHERE src = {NATION + 2} AND dst = {REGION + 2} AND label = 'in_region'")
register("property_fetch", star(lambda g: g.labelled("Customer").select("id", "segment", "acctbal")), f"SELECT {CUSTOMER} + c_custkey AS id, c_mktsegment AS segment, c_acctbal AS acctbal FROM customer")
register("graph_counts", lambda s, d: s.createDataFrame([tuple(star_graph(s, d).counts().values())], "vertices long, edges long"), f"WITH {STAR_E}, {STAR_V} SELECT (SELECT count(*) FROM v) AS vertices, (SELECT count(*) FROM e) AS edges")
register("max_id", on_star("MATCH (n) RETURN max(id(n)) AS most"), f"WITH {STAR_V} SELECT max(id) AS most FROM v")
register("empty_result", on_star("MATCH (p:Part)-[:placed]->(o:Order) RETURN p.key, o.key"), "SELECT CAST(p_partkey AS BIGINT) AS p_key, CAST(p_partkey AS BIGINT) AS o_key FROM part WHERE false")

# shapes

PAIRS = "p AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst)"
text = lambda df, column: df.withColumn(column, F.array_join(column, ","))
register(
    "cycles",
    events(lambda g: text(shapes.cycles(g, 3), "cycle")),
    f"WITH {EVENT_E}, {PAIRS} SELECT concat_ws(',', a.src, b.src, c.src) AS cycle FROM p a JOIN p b ON a.dst = b.src AND b.src > a.src JOIN p c ON b.dst = c.src AND c.dst = a.src AND c.src > a.src",
)
register(
    "simple_paths",
    events(lambda g: text(shapes.simple_paths(g, 3, g.vertices.where("id < 4").select("id")), "path")),
    f"WITH {EVENT_E}, {PAIRS} SELECT concat_ws(',', a.src, b.src, c.src, c.dst) AS path FROM p a JOIN p b ON a.dst = b.src AND b.dst <> a.src JOIN p c ON b.dst = c.src AND c.dst NOT IN (a.src, b.src) WHERE a.src IN (SELECT id FROM v WHERE id < 4)",
)
register(
    "all_paths",
    star(lambda g: text(shapes.all_paths(g, CUSTOMER + 1, REGION + 1, 5), "path")),
    f"WITH RECURSIVE {STAR_E}, {PAIRS}, t AS (SELECT [CAST({CUSTOMER + 1} AS BIGINT)] AS path UNION ALL SELECT list_append(t.path, CAST(p.dst AS BIGINT)) FROM t JOIN p ON p.src = t.path[-1] WHERE len(t.path) <= 5 AND t.path[-1] <> {REGION + 1} AND NOT list_contains(t.path, p.dst)) SELECT array_to_string(path, ',') AS path, CAST(len(path) - 1 AS INTEGER) AS hops FROM t WHERE path[-1] = {REGION + 1}",
)
register("stars", star(lambda g: shapes.stars(g, 20)), f"WITH {STAR_E}, {UNDIRECTED} SELECT a AS id, count(*) AS arms FROM u GROUP BY 1 HAVING count(*) >= 20")
MEMBERS = "s AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), t AS (SELECT id AS u, id AS v FROM v UNION SELECT t.u, s.dst FROM t JOIN s ON t.v = s.src), c AS (SELECT u AS id, min(v) AS component FROM t GROUP BY 1)"
register("communities", events(shapes.communities), f"WITH RECURSIVE {EVENT_E}, {MEMBERS} SELECT component, count(*) AS members FROM c GROUP BY 1")
register(
    "component_accessors",
    events(lambda g: (lambda c: A.component_members(c, c.agg(F.min("component")).first()[0]).withColumn("components", F.lit(A.component_count(c)).cast("long")))(A.connected_components(g))),
    f"WITH RECURSIVE {EVENT_E}, {MEMBERS} SELECT id, (SELECT count(DISTINCT component) FROM c) AS components FROM c WHERE component = (SELECT min(component) FROM c)",
)

# centralities

HOPS = "t AS (SELECT id AS s, id, 0 AS h FROM v UNION SELECT t.s, p.dst, t.h + 1 FROM t JOIN p ON p.src = t.id WHERE t.h < 6), b AS MATERIALIZED (SELECT s, id, min(h) AS h FROM t GROUP BY 1, 2)"
#: The hops in HOPS and the rounds below end at what the small tables need.
register(
    "betweenness",
    events(lambda g: rounded(A.betweenness(g), "betweenness", digits=6)),
    f"WITH RECURSIVE {EVENT_E}, {PAIRS}, {HOPS}, w AS (SELECT s, id, 0 AS h, CAST(1 AS DOUBLE) AS n FROM b WHERE h = 0 UNION ALL SELECT w.s, p.dst, w.h + 1, sum(w.n) FROM w JOIN p ON p.src = w.id JOIN b ON b.s = w.s AND b.id = p.dst AND b.h = w.h + 1 GROUP BY ALL), "
    "g AS (SELECT x.id, sum(x.n * y.n / z.n) AS n FROM w x JOIN w y ON y.s = x.id JOIN w z ON z.s = x.s AND z.id = y.id AND z.h = x.h + y.h WHERE x.h > 0 AND y.h > 0 GROUP BY 1) SELECT v.id, round(coalesce(g.n, 0), 6) AS betweenness FROM v LEFT JOIN g ON g.id = v.id",
)


def _unrolled_eigenvector(rounds: int) -> str:
    steps = ["r0 AS (SELECT id, 1e0 / sqrt((SELECT count(*) FROM v)) AS score FROM v)"]
    for k in range(1, rounds + 1):
        steps.append(f"w{k} AS MATERIALIZED (SELECT r.id, r.score + coalesce(g.s, 0) AS raw FROM r{k - 1} r LEFT JOIN (SELECT p.dst, sum(r.score) AS s FROM p JOIN r{k - 1} r ON r.id = p.src GROUP BY 1) g ON g.dst = r.id)")
        steps.append(f"r{k} AS MATERIALIZED (SELECT id, raw / (SELECT sqrt(sum(raw * raw)) FROM w{k}) AS score FROM w{k})")
    return f"WITH {EVENT_E}, p AS (SELECT DISTINCT src, dst FROM e), " + ", ".join(steps) + f" SELECT id, round(score, {DIGITS}) AS score FROM r{rounds}"


register("eigenvector", events(lambda g: rounded(A.eigenvector(g, iterations=8, tolerance=None).scores, "score")), _unrolled_eigenvector(8))
register(
    "recommendations",
    events(lambda g: GraphService(g, views.Registry("")).recommendations(5, 10)),
    f"WITH {EVENT_E}, {UNDIRECTED} SELECT y.b AS id, count(*) AS common FROM u x JOIN u y ON x.b = y.a WHERE x.a = 5 AND y.b <> 5 AND y.b NOT IN (SELECT b FROM u WHERE a = 5) GROUP BY 1 ORDER BY common DESC, id LIMIT 10",
)

# views by algorithm

_V_PR = EVENT_E.replace("e AS (", "e0 AS (") + ", e AS (SELECT DISTINCT src, dst FROM e0)"


def _view_pagerank_sql(rounds: int) -> str:
    steps = ["r0 AS (SELECT id, 1e0 / (SELECT n FROM n) AS score FROM v)"]
    for k in range(1, rounds + 1):
        steps.append(f"r{k} AS (SELECT v.id, 0.15e0 / (SELECT n FROM n) + 0.85e0 * coalesce(g.s, 0) AS score FROM v LEFT JOIN (SELECT e.dst, sum(r.score / o.n) AS s FROM e JOIN r{k - 1} r ON r.id = e.src JOIN o ON o.src = e.src GROUP BY 1) g ON g.dst = v.id)")
    return f"WITH {_V_PR}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM v), o AS (SELECT src, count(*) AS n FROM e GROUP BY 1), " + ", ".join(steps) + f" SELECT id, round(score, {DIGITS}) AS score FROM r{rounds}"


register("view_pagerank", lambda s, d: rounded(views.compute(event_graph(s, d), views.Analytics("pagerank", (("iterations", 6),))), "score"), _view_pagerank_sql(6))
register(
    "view_shortest_path",
    lambda s, d: rounded(views.compute(event_graph(s, d), views.Analytics("shortest_path", (("source", 1), ("target", 8)))), "value", digits=6),
    f"WITH RECURSIVE {EVENT_E}, m AS (SELECT src, dst, min(weight) AS w FROM e GROUP BY 1, 2), t AS (SELECT CAST(1 AS BIGINT) AS id, CAST(0 AS DOUBLE) AS d, 0 AS h UNION ALL SELECT id, min(d), h FROM (SELECT m.dst AS id, t.d + m.w AS d, t.h + 1 AS h FROM t JOIN m ON m.src = t.id WHERE t.h < 30) GROUP BY id, h) SELECT round(min(d), 6) AS value FROM t WHERE id = 8",
)

# edge changes


def placed_orders(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Customers and orders with the edges that customers placed."""
    graph = star_graph(spark, sf_dir)
    return PropertyGraph(graph.vertices, graph.edges_labelled("placed"))


def edge_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders lose their edge, finished ones get the price as weight, open ones a second edge."""
    o = read(spark, sf_dir, "orders")
    op = F.when(F.col("o_orderpriority") == "1-URGENT", "remove_edge").when(F.col("o_orderstatus") == "F", "update_edge").when(F.col("o_orderstatus") == "O", "add_edge")
    label = F.when(op == "add_edge", "watches").otherwise("placed")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("id", "long"), ("before", "map<string,string>"))]
    after = F.create_map(F.lit("weight"), F.col("o_totalprice").cast("string"))
    rows = o.select(F.col("o_orderkey").alias("seq"), F.lit("o").alias("changeset_id"), F.lit("o").alias("source"), op.alias("op"), (F.lit(CUSTOMER) + F.col("o_custkey")).alias("src"), (F.lit(ORDER) + F.col("o_orderkey")).alias("dst"), label.alias("label"), after.alias("after"), *none)
    return rows.where("op is not null").select(*(c.split()[0] for c in SCHEMA.split(", ")))


register(
    "edge_operations",
    lambda s, d: fold(placed_orders(s, d), edge_changes(s, d)).edges.select("src", "dst", "label", "weight"),
    f"WITH x AS (SELECT {CUSTOMER} + o_custkey AS src, {ORDER} + o_orderkey AS dst, o_orderpriority = '1-URGENT' AS gone, o_orderstatus AS status, o_totalprice FROM orders) "
    "SELECT src, dst, 'placed' AS label, CASE WHEN status = 'F' THEN o_totalprice ELSE 1.0::DOUBLE END AS weight FROM x WHERE NOT gone UNION ALL SELECT src, dst, 'watches', o_totalprice FROM x WHERE NOT gone AND status = 'O'",
)

# the store


def stored_nations(spark: SparkSession, sf_dir: str) -> GraphStore:
    """Regions and nations, a bounded list, by transactions: added, moved, deleted by pattern, folded into a snapshot."""
    regions, nations = read(spark, sf_dir, "region").collect(), read(spark, sf_dir, "nation").collect()
    store = GraphStore(spark, new_dir(spark, "store"), "id long, type string, key long, name string", "src long, dst long, label string, weight double")
    first = store.begin()
    for r in regions:
        first.add_vertex(REGION + r["r_regionkey"], type="Region", key=r["r_regionkey"], name=r["r_name"])
    store.commit(first)
    second = store.begin()
    for r in nations:
        second.add_vertex(NATION + r["n_nationkey"], type="Nation", key=r["n_nationkey"], name=r["n_name"])
        second.add_edge(NATION + r["n_nationkey"], REGION + r["n_regionkey"], "in_region", weight=1.0)
    store.commit(second)
    dropped = store.begin().remove_vertex(REGION)
    store.rollback(dropped)
    store.commit(dropped)
    third = store.begin()
    for r in nations:
        if r["n_nationkey"] % 2:
            third.update_edge(NATION + r["n_nationkey"], REGION + r["n_regionkey"], "in_region", weight=float(r["n_nationkey"]))
        if r["n_nationkey"] < 3:
            third.update_vertex(NATION + r["n_nationkey"], type="Nation", key=r["n_nationkey"], name="renamed")
    third.remove_edge(NATION + 4, REGION + nations[4]["n_regionkey"], "in_region")
    store.commit(third)
    store.checkpoint()
    store.execute("MATCH (n:Nation) WHERE n.key >= 20 DELETE n")
    return GraphStore(spark, store.path, store.vertices, store.edges)


register(
    "store_vertices",
    lambda s, d: stored_nations(s, d).graph().vertices,
    f"SELECT {REGION} + r_regionkey AS id, 'Region' AS type, CAST(r_regionkey AS BIGINT) AS key, r_name AS name FROM region UNION ALL SELECT {NATION} + n_nationkey, 'Nation', n_nationkey, CASE WHEN n_nationkey < 3 THEN 'renamed' ELSE n_name END FROM nation WHERE n_nationkey < 20",
)
register(
    "store_edges",
    lambda s, d: stored_nations(s, d).graph().edges,
    f"SELECT {NATION} + n_nationkey AS src, {REGION} + n_regionkey AS dst, 'in_region' AS label, CASE WHEN n_nationkey % 2 = 1 THEN CAST(n_nationkey AS DOUBLE) ELSE 1.0 END AS weight FROM nation WHERE n_nationkey < 20 AND n_nationkey <> 4",
)
register(
    "store_stats",
    lambda s, d: s.createDataFrame([tuple(stored_nations(s, d).stats()[k] for k in ("vertices", "edges", "version"))], "vertices long, edges long, version long"),
    "WITH r AS (SELECT count(*) AS n FROM region), n AS (SELECT count(*) AS n, count(*) FILTER (n_nationkey < 20) AS kept, count(*) FILTER (n_nationkey % 2 = 1) AS odd FROM nation) SELECT r.n + n.kept AS vertices, n.kept - 1 AS edges, CAST(r.n + 2 * n.n + n.odd + 3 + 1 + (n.n - n.kept) AS BIGINT) AS version FROM r, n",
)

# maintained views


def maintained(kind, name: str = "kept"):
    def run(spark: SparkSession, sf_dir: str):
        engine = maintenance.Engine(customers(spark, sf_dir))
        engine.register(views.View(name, kind))
        engine.process(order_changes(spark, sf_dir))
        return engine.results[name]

    return run


KEYS = tuple(CUSTOMER + k for k in range(1, 40, 3))
register("view_delta_lookup", maintained(views.Lookup(KEYS)), f"WITH {FOLDED} SELECT * FROM folded WHERE id IN {KEYS}")
for _function, _sql in (("sum", "round(sum(value), 6)"), ("max", "max(value)"), ("count", "CAST(count(*) AS DOUBLE)")):
    register(f"view_delta_{_function}", lambda s, d, f=_function: rounded(maintained(views.Aggregation(f, ("segment",)))(s, d), "value", digits=6), f"WITH {FOLDED} SELECT segment, {_sql} AS value FROM folded GROUP BY 1")


def hybrid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a hybrid view after the changes, one above the other."""
    kind = views.Hybrid((views.Aggregation("min"), views.Aggregation("count", ("segment",)), views.Lookup(KEYS)))
    least, counts, found = maintained(kind)(spark, sf_dir)
    rows = least.select(F.lit("least").alias("part"), F.lit(None).cast("string").alias("name"), "value")
    rows = rows.unionByName(counts.select(F.lit("count").alias("part"), F.col("segment").alias("name"), "value"))
    return rows.unionByName(found.select(F.lit("lookup").alias("part"), F.col("id").cast("string").alias("name"), "value"))


register(
    "view_delta_hybrid",
    hybrid_rows,
    f"WITH {FOLDED} SELECT 'least' AS part, CAST(NULL AS VARCHAR) AS name, min(value) AS value FROM folded UNION ALL SELECT 'count', segment, count(*) FROM folded GROUP BY segment UNION ALL SELECT 'lookup', CAST(id AS VARCHAR), value FROM folded WHERE id IN {KEYS}",
)


def delta_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles and components after purchases' edges came and errors' edges went."""
    graph = event_graph(spark, sf_dir)
    engine = maintenance.Engine(PropertyGraph(graph.vertices, graph.edges.where("label <> 'purchase'").select("src", "dst", "label")))
    engine.register(views.View("shape", views.Hybrid((views.Analytics("triangle_count"), views.Analytics("connectivity")))))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("id", "long"), ("before", "map<string,string>"), ("after", "map<string,string>"))]
    moved = graph.edges.where("label IN ('purchase', 'error')")
    log = moved.select(F.xxhash64("src", "dst", "label").bitwiseAND(F.lit(2**62 - 1)).alias("seq"), F.lit("e").alias("changeset_id"), F.lit("e").alias("source"), F.when(F.col("label") == "purchase", "add_edge").otherwise("remove_edge").alias("op"), "src", "dst", "label", *none)
    engine.process(log.select(*(c.split()[0] for c in SCHEMA.split(", "))))
    triangles, parts = engine.results["shape"]
    return triangles.select(F.lit("triangles").alias("part"), "value").unionByName(parts.select(F.lit("components").alias("part"), "value"))


register(
    "view_delta_analytics",
    delta_triangles,
    f"WITH RECURSIVE {EVENT_E.replace('e AS (', 'e0 AS (')}, e AS (SELECT src, dst FROM e0 WHERE label <> 'error'), {UNDIRECTED}, {MEMBERS} "
    "SELECT 'triangles' AS part, count(*) AS value FROM u x JOIN u y ON x.b = y.a AND y.b > x.b JOIN u z ON z.a = x.a AND z.b = y.b WHERE x.a < x.b UNION ALL SELECT 'components', count(DISTINCT component) FROM c",
)
