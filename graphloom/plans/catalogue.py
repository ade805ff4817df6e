"""The queries of the graph engine and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph
from graphloom.operators import algorithms as A
from graphloom.operators import traverse as V
from graphloom.sources.tables import SPAN, event_graph, star_graph

from .matching import query

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "match_1hop"

DIGITS = 9
CUSTOMER, SUPPLIER, PART, ORDER, NATION, REGION = 3 * SPAN, 4 * SPAN, 5 * SPAN, 6 * SPAN, 2 * SPAN, SPAN

#: The star schema's edges in SQL.
STAR_E = f"""e AS (
  SELECT {CUSTOMER} + o_custkey AS src, {ORDER} + o_orderkey AS dst, 'placed' AS label, 1.0::DOUBLE AS weight FROM orders
  UNION ALL SELECT {ORDER} + l_orderkey, {PART} + l_partkey, 'contains', sum(l_quantity) FROM lineitem GROUP BY ALL
  UNION ALL SELECT {PART} + l_partkey, {SUPPLIER} + l_suppkey, 'supplied_by', sum(l_quantity) FROM lineitem GROUP BY ALL
  UNION ALL SELECT {ORDER} + l_orderkey, {SUPPLIER} + l_suppkey, 'fulfilled_by', sum(l_quantity) FROM lineitem GROUP BY ALL
  UNION ALL SELECT {CUSTOMER} + c_custkey, {NATION} + c_nationkey, 'located_in', 1.0 FROM customer
  UNION ALL SELECT {SUPPLIER} + s_suppkey, {NATION} + s_nationkey, 'located_in', 1.0 FROM supplier
  UNION ALL SELECT {NATION} + n_nationkey, {REGION} + n_regionkey, 'in_region', 1.0 FROM nation
)"""
STAR_V = f"""v AS (
  SELECT {REGION} + r_regionkey AS id, 'Region' AS type FROM region UNION ALL SELECT {NATION} + n_nationkey, 'Nation' FROM nation
  UNION ALL SELECT {CUSTOMER} + c_custkey, 'Customer' FROM customer UNION ALL SELECT {SUPPLIER} + s_suppkey, 'Supplier' FROM supplier
  UNION ALL SELECT {PART} + p_partkey, 'Part' FROM part UNION ALL SELECT {ORDER} + o_orderkey, 'Order' FROM orders
)"""
EVENT_E = """steps AS (
  SELECT lag(user_id) OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS src, user_id AS dst, event_type AS label, value FROM events
), e AS (
  SELECT src, dst, label, avg(value) AS weight, count(*) AS times FROM steps WHERE src IS NOT NULL GROUP BY ALL
), v AS (SELECT DISTINCT user_id AS id FROM events)"""


def register(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def rounded(df: DataFrame, *columns: str, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def on_star(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = query(star_graph(spark, sf_dir), text)
        return found.toDF(*(c.replace(".", "_") for c in found.columns))

    return run


def star(f: Callable[[PropertyGraph], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(star_graph(spark, sf_dir))


def events(f: Callable[[PropertyGraph], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(event_graph(spark, sf_dir))


# patterns

register(
    "match_1hop",
    on_star("MATCH (c:Customer)-[:placed]->(o:Order) WHERE o.totalprice > 100000 RETURN c.name, o.totalprice"),
    "SELECT c_name, o_totalprice AS o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 100000",
)
register(
    "match_filter",
    on_star("MATCH (p:Part) WHERE p.size > 25 AND p.price < 950 RETURN p.key, p.name, p.size"),
    "SELECT CAST(p_partkey AS BIGINT) AS p_key, p_name, CAST(p_size AS DOUBLE) AS p_size FROM part WHERE p_size > 25 AND p_retailprice < 950",
)
register(
    "match_2hop",
    on_star("MATCH (c:Customer)-[:placed]->(o:Order)-[k:contains]->(p:Part) WHERE p.size >= 45 RETURN c.key, o.key, p.key, k.weight"),
    f"WITH {STAR_E} SELECT c_custkey AS c_key, o_orderkey AS o_key, p_partkey AS p_key, e.weight AS k_weight FROM customer JOIN orders ON o_custkey = c_custkey "
    f"JOIN e ON e.label = 'contains' AND e.src = {ORDER} + o_orderkey JOIN part ON e.dst = {PART} + p_partkey WHERE p_size >= 45",
)
register(
    "match_incoming",
    on_star("MATCH (n:Nation)<-[:located_in]-(s:Supplier) RETURN n.name, s.name"),
    "SELECT n_name, s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey",
)
register(
    "match_undirected",
    on_star("MATCH (n:Nation)-[e:located_in]-(x) WHERE n.key < 5 RETURN n.name, x.type, x.key, e.label"),
    "SELECT n_name, 'Customer' AS x_type, CAST(c_custkey AS BIGINT) AS x_key, 'located_in' AS e_label FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey < 5 "
    "UNION ALL SELECT n_name, 'Supplier', CAST(s_suppkey AS BIGINT), 'located_in' FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey < 5",
)
register(
    "match_multi_pred",
    on_star("MATCH (c:Customer {segment: 'BUILDING'})-[:placed]->(o:Order) WHERE (o.totalprice > 150000 OR o.status = 'F') AND c.acctbal >= 0 RETURN c.key, o.key, o.status"),
    "SELECT c_custkey AS c_key, o_orderkey AS o_key, o_orderstatus AS o_status FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND (o_totalprice > 150000 OR o_orderstatus = 'F') AND c_acctbal >= 0",
)
register(
    "match_reused_variable",
    on_star("MATCH (o:Order)-[:contains]->(p:Part)-[:supplied_by]->(s:Supplier), (o)-[:fulfilled_by]->(s) RETURN s.key, count(*) AS ways"),
    f"WITH {STAR_E} SELECT CAST(b.dst - {SUPPLIER} AS BIGINT) AS s_key, count(*) AS ways FROM e a JOIN e b ON b.label = 'supplied_by' AND a.dst = b.src "
    "JOIN e c ON c.label = 'fulfilled_by' AND c.src = a.src AND c.dst = b.dst WHERE a.label = 'contains' GROUP BY 1",
)
register(
    "return_var",
    on_star("MATCH (c:Customer)-[:located_in]->(n:Nation {name: 'NATION_3'}) RETURN n"),
    f"SELECT {NATION} + n_nationkey AS n_id, 'Nation' AS n_type, CAST(n_nationkey AS BIGINT) AS n_key, n_name, CAST(NULL AS DOUBLE) AS n_acctbal, CAST(NULL AS VARCHAR) AS n_segment, "
    "CAST(NULL AS VARCHAR) AS n_brand, CAST(NULL AS VARCHAR) AS n_kind, CAST(NULL AS DOUBLE) AS n_size, CAST(NULL AS DOUBLE) AS n_price, CAST(NULL AS VARCHAR) AS n_status, "
    "CAST(NULL AS DOUBLE) AS n_totalprice, CAST(NULL AS VARCHAR) AS n_priority FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'",
)
register(
    "return_star",
    on_star("MATCH (s:Supplier)-[:located_in]->(n:Nation) RETURN *"),
    f"SELECT {SUPPLIER} + s_suppkey AS id, 'Supplier' AS type, CAST(s_suppkey AS BIGINT) AS key, s_name AS name, s_acctbal AS acctbal, CAST(NULL AS VARCHAR) AS segment, CAST(NULL AS VARCHAR) AS brand, "
    "CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS DOUBLE) AS size, CAST(NULL AS DOUBLE) AS price, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS DOUBLE) AS totalprice, CAST(NULL AS VARCHAR) AS priority "
    f"FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT {NATION} + n_nationkey, 'Nation', CAST(n_nationkey AS BIGINT), n_name, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL "
    "FROM supplier JOIN nation ON s_nationkey = n_nationkey",
)
register(
    "where_ne_missing",
    on_star("MATCH (n) WHERE n.size != 10 OR n.status != 'F' RETURN id(n) AS vertex"),
    f"SELECT {PART} + p_partkey AS vertex FROM part WHERE p_size <> 10 UNION ALL SELECT {ORDER} + o_orderkey FROM orders WHERE o_orderstatus <> 'F'",
)
register(
    "match_not_distinct_order",
    on_star("MATCH (c:Customer)-[:located_in]->(n:Nation) WHERE NOT c.acctbal < 5000 RETURN n.name, count(distinct c.segment) AS segments, avg(c.acctbal) AS mean ORDER BY n.name LIMIT 10"),
    "SELECT n_name, count(DISTINCT c_mktsegment) AS segments, avg(c_acctbal) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE NOT c_acctbal < 5000 GROUP BY 1 ORDER BY 1 LIMIT 10",
)

# neighbours and measures

HUB = NATION + 3
register("out_neighbors", star(lambda g: V.out_neighbors(g, ORDER + 7).select("neighbor", "label")), f"WITH {STAR_E} SELECT dst AS neighbor, label FROM e WHERE src = {ORDER + 7}")
register("in_neighbors", star(lambda g: V.in_neighbors(g, HUB).select("neighbor", "label")), f"WITH {STAR_E} SELECT src AS neighbor, label FROM e WHERE dst = {HUB}")
register("all_neighbors", star(lambda g: V.all_neighbors(g, HUB).select("neighbor", "label")), f"WITH {STAR_E} SELECT dst AS neighbor, label FROM e WHERE src = {HUB} UNION ALL SELECT src, label FROM e WHERE dst = {HUB}")
register("neighbor_ids", events(lambda g: V.neighbor_ids(g, 5)), f"WITH {EVENT_E} SELECT dst AS id FROM e WHERE src = 5 UNION SELECT src FROM e WHERE dst = 5")
register("two_hop", star(lambda g: V.two_hop(g, CUSTOMER + 1)), f"WITH {STAR_E} SELECT DISTINCT b.dst AS id FROM e a JOIN e b ON a.dst = b.src WHERE a.src = {CUSTOMER + 1} AND b.dst <> a.src")
register("two_hop_pairs", events(V.two_hop_pairs), f"WITH {EVENT_E} SELECT DISTINCT a.src AS start, b.dst AS id FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> b.dst")
register("edges_between", events(lambda g: V.edges_between(g, 3, 4).select("src", "dst", "label")), f"WITH {EVENT_E} SELECT src, dst, label FROM e WHERE (src = 3 AND dst = 4) OR (src = 4 AND dst = 3)")
register("vertices_by_label", star(lambda g: g.labelled("Supplier").select("id", "name")), f"SELECT {SUPPLIER} + s_suppkey AS id, s_name AS name FROM supplier")
register("edges_by_label", star(lambda g: g.edges_labelled("in_region").select("src", "dst")), f"SELECT {NATION} + n_nationkey AS src, CAST({REGION} + n_regionkey AS BIGINT) AS dst FROM nation")
register("vertex_point_read", star(lambda g: g.vertex(CUSTOMER + 11).select("id", "type", "name")), f"SELECT {CUSTOMER} + c_custkey AS id, 'Customer' AS type, c_name AS name FROM customer WHERE c_custkey = 11")
register("edge_point_read", star(lambda g: g.edge(NATION + 2, REGION + 2).select("src", "dst", "label")), f"WITH {STAR_E} SELECT src, dst, label FROM e WHERE src = {NATION + 2} AND dst = {REGION + 2}")
register("predicate_scan", star(lambda g: g.vertices_where(F.col("price") > 990, type="Part").select("id", "price")), f"SELECT {PART} + p_partkey AS id, p_retailprice AS price FROM part WHERE p_retailprice > 990")
register("edge_predicate_scan", star(lambda g: g.edges_where(F.col("weight") >= 80).select("src", "dst", "label", "weight")), f"WITH {STAR_E} SELECT src, dst, label, weight FROM e WHERE weight >= 80")
DEGREES = "d AS (SELECT v.id, (SELECT 0) + coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM v LEFT JOIN (SELECT src, count(*) n FROM e GROUP BY 1) o ON o.src = v.id LEFT JOIN (SELECT dst, count(*) n FROM e GROUP BY 1) i ON i.dst = v.id)"
register("degrees", star(V.degrees), f"WITH {STAR_E}, {STAR_V}, {DEGREES} SELECT id, out_degree, in_degree, out_degree + in_degree AS degree FROM d")
register("most_connected", star(V.most_connected), f"WITH {STAR_E}, {STAR_V}, {DEGREES} SELECT id, out_degree + in_degree AS degree FROM d WHERE out_degree + in_degree = (SELECT max(out_degree + in_degree) FROM d)")
register("density", star(lambda g: V.density(g)), f"WITH {STAR_E}, {STAR_V}, n AS (SELECT (SELECT count(*) FROM v) AS vertices, (SELECT count(*) FROM e) AS edges) SELECT *, CASE WHEN vertices > 1 THEN edges / (vertices * (vertices - 1)) ELSE 0 END AS density FROM n")
register("average_degree", star(V.average_degree), f"WITH {STAR_E}, {STAR_V} SELECT 2.0::DOUBLE * (SELECT count(*) FROM e) / (SELECT count(*) FROM v) AS average_degree")
register("label_histogram", star(V.label_histogram), f"WITH {STAR_E} SELECT label, count(*) AS edges FROM e GROUP BY 1")
MATRIX = [REGION + k for k in range(3)] + [NATION + k for k in range(4)]
register(
    "adjacency_matrix",
    star(lambda g: V.adjacency_matrix(g, MATRIX).toDF("src", *(f"to_{i}" for i in MATRIX))),
    f"WITH {STAR_E}, ids AS (SELECT unnest({MATRIX}) AS src) SELECT ids.src, " + ", ".join(f"coalesce(sum(weight) FILTER (dst = {i}), 0) AS to_{i}" for i in MATRIX) + " FROM ids LEFT JOIN e ON e.src = ids.src GROUP BY 1",
)
UNDIRECTED = "u AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e) WHERE a <> b)"
register(
    "common_neighbors",
    events(V.common_neighbors),
    f"WITH {EVENT_E}, {UNDIRECTED} SELECT x.b AS a, y.b AS b, count(*) AS common FROM u x JOIN u y ON x.a = y.a AND x.b < y.b "
    "WHERE NOT EXISTS (SELECT 1 FROM u z WHERE z.a = x.b AND z.b = y.b) GROUP BY 1, 2",
)

# algorithms


def _unrolled_pagerank(graph: str, rounds: int, base: str, first: str) -> str:
    steps = [f"r0 AS (SELECT id, {first} AS score FROM v)"]
    for k in range(1, rounds + 1):
        steps.append(
            f"r{k} AS (SELECT v.id, {base} + 0.85e0 * coalesce(g.s, 0) AS score FROM v LEFT JOIN (SELECT e.dst, sum(r.score / o.n) AS s FROM e JOIN r{k - 1} r ON r.id = e.src JOIN o ON o.src = e.src GROUP BY 1) g ON g.dst = v.id)"
        )
    return f"WITH {graph}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM v), o AS (SELECT src, count(*) AS n FROM e GROUP BY 1), " + ", ".join(steps) + f" SELECT id, round(score, {DIGITS}) AS score FROM r{rounds}"


register("pagerank", events(lambda g: rounded(A.pagerank(g, iterations=10, tolerance=None).scores, "score")), _unrolled_pagerank(EVENT_E, 10, "0.15e0 / (SELECT n FROM n)", "1e0 / (SELECT n FROM n)"))
register("pagerank_unnormalised", events(lambda g: rounded(A.pagerank(g, iterations=10, tolerance=None, normalized=False).scores, "score")), _unrolled_pagerank(EVENT_E, 10, "0.15e0", "1e0"))
register("pagerank_star", star(lambda g: rounded(A.pagerank(g, iterations=5, tolerance=None).scores, "score", digits=12)), _unrolled_pagerank(f"{STAR_E}, {STAR_V}", 5, "0.15e0 / (SELECT n FROM n)", "1e0 / (SELECT n FROM n)").replace(f"round(score, {DIGITS})", "round(score, 12)"))
register(
    "pagerank_top",
    events(lambda g: rounded(A.pagerank(g, iterations=10, tolerance=None).top(10), "score")),
    _unrolled_pagerank(EVENT_E, 10, "0.15e0 / (SELECT n FROM n)", "1e0 / (SELECT n FROM n)") + " ORDER BY score DESC, id LIMIT 10",
)


def _unrolled_components(rounds: int) -> str:
    steps = ["c0 AS (SELECT id, id AS c FROM v)"]
    for r in range(1, rounds + 1):
        steps.append(f"c{r} AS MATERIALIZED (SELECT c.id, least(c.c, coalesce(min(n.c), c.c)) AS c FROM c{r - 1} c LEFT JOIN u ON u.a = c.id LEFT JOIN c{r - 1} n ON n.id = u.b GROUP BY c.id, c.c)")
    return f"WITH {STAR_E}, {STAR_V}, {UNDIRECTED}, " + ", ".join(steps) + f" SELECT id, c AS component FROM c{rounds}"


register("components", star(A.connected_components), _unrolled_components(8))
CLOSURE = "t AS (SELECT DISTINCT src AS u, dst AS v FROM e UNION SELECT t.u, e.dst FROM t JOIN e ON t.v = e.src)"
register("reachability", events(A.reachability), f"WITH RECURSIVE {EVENT_E}, {CLOSURE} SELECT u, v FROM t")
register("event_components", events(A.connected_components), f"WITH RECURSIVE {EVENT_E}, s AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), t AS (SELECT id AS u, id AS v FROM v UNION SELECT t.u, s.dst FROM t JOIN s ON t.v = s.src) SELECT u AS id, min(v) AS component FROM t GROUP BY 1")
register(
    "scc",
    events(A.strongly_connected),
    f"WITH RECURSIVE {EVENT_E}, {CLOSURE} SELECT v.id, least(v.id, coalesce(min(t.v), v.id)) AS component FROM v LEFT JOIN (SELECT a.u, a.v FROM t a JOIN t b ON a.u = b.v AND a.v = b.u) t ON t.u = v.id GROUP BY 1",
)
register(
    "bfs_levels",
    events(lambda g: A.bfs_levels(g, 1)),
    f"WITH RECURSIVE {EVENT_E}, t AS (SELECT CAST(1 AS BIGINT) AS id, 0 AS hops UNION SELECT e.dst, t.hops + 1 FROM t JOIN e ON e.src = t.id WHERE t.hops < 6) SELECT id, min(hops) AS hops FROM t GROUP BY 1",
)
register(
    "sssp_weighted",
    events(lambda g: rounded(A.shortest_distances(g, 1), "distance", digits=6).fillna(-1, ["via"])),
    f"WITH RECURSIVE {EVENT_E}, m AS (SELECT src, dst, min(weight) AS w FROM e GROUP BY 1, 2), t AS (SELECT CAST(1 AS BIGINT) AS id, CAST(0 AS DOUBLE) AS d, 0 AS h UNION ALL SELECT id, min(d), h FROM (SELECT m.dst AS id, t.d + m.w AS d, t.h + 1 AS h FROM t JOIN m ON m.src = t.id WHERE t.h < 30) GROUP BY id, h), "
    "b AS (SELECT id, min(d) AS d FROM t GROUP BY 1) SELECT b.id, round(b.d, 6) AS distance, coalesce((SELECT min(m.src) FROM m JOIN b p ON p.id = m.src WHERE m.dst = b.id AND b.id <> 1 AND abs(p.d + m.w - b.d) < 1e-9), -1) AS via FROM b",
)
register(
    "shortest_path_len",
    lambda spark, sf_dir: spark.createDataFrame([(len(V.shortest_path(star_graph(spark, sf_dir), CUSTOMER + 1, REGION, 6) or [0]) - 1,)], "hops long"),
    f"WITH RECURSIVE {STAR_E}, t AS (SELECT CAST({CUSTOMER + 1} AS BIGINT) AS id, 0 AS h UNION SELECT e.dst, h + 1 FROM t JOIN e ON e.src = t.id WHERE h < 6) SELECT CAST(coalesce(min(h), -1) AS BIGINT) AS hops FROM t WHERE id = {REGION}",
)
register(
    "path_exists",
    lambda spark, sf_dir: spark.createDataFrame([(A.path_exists(star_graph(spark, sf_dir), CUSTOMER + 1, REGION + 2), A.path_exists(star_graph(spark, sf_dir), REGION + 2, CUSTOMER + 1))], "there boolean, back boolean"),
    f"WITH RECURSIVE {STAR_E}, t AS (SELECT CAST({CUSTOMER + 1} AS BIGINT) AS id UNION SELECT e.dst FROM t JOIN e ON e.src = t.id) SELECT coalesce(bool_or(id = {REGION + 2}), false) AS there, false AS back FROM t",
)
register(
    "triangles",
    star(A.triangles),
    # edges run from fewer to more neighbours, so that no hub's pairs are listed
    f"WITH {STAR_E}, {UNDIRECTED}, d AS (SELECT a, count(*) AS n FROM u GROUP BY 1), o AS MATERIALIZED (SELECT u.a, u.b FROM u JOIN d x ON x.a = u.a JOIN d y ON y.a = u.b WHERE (x.n, u.a) < (y.n, u.b)), "
    "t AS (SELECT list_sort([x.a, x.b, y.b]) AS t FROM o x JOIN o y ON x.b = y.a JOIN o z ON z.a = x.a AND z.b = y.b) SELECT t[1] AS a, t[2] AS b, t[3] AS c FROM t",
)
register(
    "clustering",
    events(lambda g: rounded(A.clustering(g), "coefficient")),
    f"WITH {EVENT_E}, {UNDIRECTED}, t AS (SELECT x.a AS id, count(*) AS n FROM u x JOIN u y ON x.a = y.a AND x.b < y.b JOIN u z ON z.a = x.b AND z.b = y.b GROUP BY 1), d AS (SELECT a, count(*) AS n FROM u GROUP BY 1) "
    f"SELECT v.id, coalesce(t.n, 0) AS triangles, CASE WHEN d.n > 1 THEN round(2.0::DOUBLE * coalesce(t.n, 0) / (d.n * (d.n - 1)), {DIGITS}) ELSE 0 END AS coefficient FROM v LEFT JOIN t ON t.id = v.id LEFT JOIN d ON d.a = v.id",
)


def _unrolled_core(k: int, rounds: int) -> str:
    steps = ["c0 AS (SELECT src, dst, label FROM e)"]
    for r in range(1, rounds + 1):
        ends = f"SELECT id FROM (SELECT src AS id FROM c{r - 1} UNION ALL SELECT dst FROM c{r - 1}) GROUP BY 1 HAVING count(*) >= {k}"
        steps.append(f"c{r} AS MATERIALIZED (SELECT * FROM c{r - 1} WHERE src IN ({ends}) AND dst IN ({ends}))")
    return f"WITH {STAR_E}, " + ", ".join(steps) + f" SELECT src, dst, label FROM c{rounds}"


register("k_core", star(lambda g: A.k_core(g, 9).select("src", "dst", "label")), _unrolled_core(9, 25))
register(
    "degree_centrality",
    events(lambda g: rounded(A.degree_centrality(g), "centrality")),
    f"WITH {EVENT_E}, p AS (SELECT DISTINCT src, dst FROM e), d AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM p UNION ALL SELECT dst FROM p) GROUP BY 1) SELECT v.id, round(coalesce(d.n, 0) / (2.0::DOUBLE * ((SELECT count(*) FROM v) - 1)), {DIGITS}) AS centrality FROM v LEFT JOIN d ON d.id = v.id",
)
register(
    "closeness",
    events(lambda g: rounded(A.closeness(g), "closeness")),
    f"WITH RECURSIVE {EVENT_E}, p AS (SELECT DISTINCT src, dst FROM e), t AS (SELECT id AS s, id, 0 AS h FROM v UNION SELECT t.s, p.dst, t.h + 1 FROM t JOIN p ON p.src = t.id WHERE t.h < 6), b AS (SELECT s, id, min(h) AS h FROM t GROUP BY 1, 2) "
    f"SELECT s AS id, CASE WHEN sum(h) > 0 THEN round(count(*) FILTER (h > 0) / CAST(sum(h) AS DOUBLE), {DIGITS}) ELSE 0 END AS closeness FROM b GROUP BY 1",
)
