"""Queries over views, changes, windows and event stages, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph
from graphloom.sources.changelog import SCHEMA, fold
from graphloom.sources.streams import replay
from graphloom.sources.tables import SPAN, event_graph, read, star_graph
from graphloom.streaming import alerts, transform, windows
from graphloom.streaming.processor import drained

from . import maintenance, sqlviews, views
from .catalogue import CUSTOMER, EVENT_E, STAR_E, register, rounded


def customers(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Customers with their balance as ``value``."""
    found = read(spark, sf_dir, "customer").select((F.lit(CUSTOMER) + F.col("c_custkey")).alias("id"), F.lit("Customer").alias("type"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("value"))
    return PropertyGraph(found, spark.createDataFrame([], "src long, dst long, label string"))


def _aggregate(function: str, *groups: str, filters: tuple = ()):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(views.compute(customers(spark, sf_dir), views.Aggregation(function, groups, filters)), "value", digits=7)

    return run


for _name, _sql in (("count", "CAST(count(*) AS DOUBLE)"), ("sum", "round(sum(c_acctbal), 7)"), ("avg", "round(sum(c_acctbal) / count(*), 7)"), ("min", "min(c_acctbal)"), ("max", "max(c_acctbal)")):
    register(f"view_{_name}", _aggregate(_name), f"SELECT {_sql} AS value FROM customer")
register("view_group_by", _aggregate("avg", "segment"), "SELECT c_mktsegment AS segment, round(sum(c_acctbal) / count(*), 7) AS value FROM customer GROUP BY 1")
register("view_filtered", _aggregate("sum", filters=(("segment", "BUILDING"),)), "SELECT round(sum(c_acctbal), 7) AS value FROM customer WHERE c_mktsegment = 'BUILDING'")
register("view_lookup", lambda s, d: views.compute(customers(s, d), views.Lookup((CUSTOMER + 3, CUSTOMER + 5, 1))), f"SELECT {CUSTOMER} + c_custkey AS id, 'Customer' AS type, c_mktsegment AS segment, c_acctbal AS value FROM customer WHERE c_custkey IN (3, 5)")
register("view_connectivity", lambda s, d: views.compute(event_graph(s, d), views.Analytics("connectivity")), f"WITH RECURSIVE {EVENT_E}, s AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), t AS (SELECT id AS u, id AS v FROM v UNION SELECT t.u, s.dst FROM t JOIN s ON t.v = s.src) SELECT count(DISTINCT c) AS value FROM (SELECT u, min(v) AS c FROM t GROUP BY 1)")
register("view_triangle_count", lambda s, d: views.compute(event_graph(s, d), views.Analytics("triangle_count")), f"WITH {EVENT_E}, u AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e) WHERE a <> b) SELECT count(*) AS value FROM u x JOIN u y ON x.b = y.a AND y.b > x.b JOIN u z ON z.a = x.a AND z.b = y.b WHERE x.a < x.b")


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a change log over customers: finished ones set the balance, urgent ones remove the customer, others add to it."""
    o = read(spark, sf_dir, "orders")
    op = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("remove_vertex")).when(F.col("o_orderstatus") == "F", F.lit("update_vertex")).otherwise(F.lit("add_vertex"))
    after = F.create_map(F.lit("type"), F.lit("Customer"), F.lit("segment"), F.col("o_orderstatus"), F.lit("value"), F.col("o_totalprice").cast("string"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("src", "long"), ("dst", "long"), ("label", "string"), ("before", "map<string,string>"))]
    row = o.select((F.col("o_orderkey") + 1).alias("seq"), F.lit("orders").alias("changeset_id"), F.lit("orders").alias("source"), op.alias("op"), (F.lit(CUSTOMER) + F.col("o_custkey")).alias("id"), *none, F.when(op != "remove_vertex", after).alias("after"))
    return row.select(*(c.split()[0] for c in SCHEMA.split(", ")))


FOLDED = f"""last AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders
), folded AS (
  SELECT {CUSTOMER} + o_custkey AS id, 'Customer' AS type, o_orderstatus AS segment, o_totalprice AS value FROM last WHERE n = 1 AND o_orderpriority <> '1-URGENT'
  UNION ALL SELECT {CUSTOMER} + c_custkey, 'Customer', c_mktsegment, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
)"""
register("changelog_fold", lambda s, d: fold(customers(s, d), order_changes(s, d)).vertices, f"WITH {FOLDED} SELECT * FROM folded")


def removed_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that are left when customers with debts go."""
    graph = star_graph(spark, sf_dir)
    debts = graph.vertices_where(F.col("acctbal") < 0, type="Customer").select(F.col("id"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("src", "long"), ("dst", "long"), ("label", "string"), ("before", "map<string,string>"), ("after", "map<string,string>"))]
    log = debts.select(F.col("id").alias("seq"), F.lit("c").alias("changeset_id"), F.lit("c").alias("source"), F.lit("remove_vertex").alias("op"), "id", *none)
    return fold(graph, log).edges.select("src", "dst", "label")


register("remove_vertex_cascade", removed_vertices, f"WITH {STAR_E}, g AS (SELECT {CUSTOMER} + c_custkey AS id FROM customer WHERE c_acctbal < 0) SELECT src, dst, label FROM e WHERE src NOT IN (SELECT id FROM g) AND dst NOT IN (SELECT id FROM g)")


def delta_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An average by segment kept current by signed deltas, not computed again."""
    engine = maintenance.Engine(customers(spark, sf_dir))
    engine.register(views.View("mean", views.Aggregation("avg", ("segment",))))
    engine.process(order_changes(spark, sf_dir))
    return rounded(engine.results["mean"], "value", digits=7)


def delta_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = maintenance.Engine(customers(spark, sf_dir))
    engine.register(views.View("least", views.Aggregation("min", ("segment",))))
    engine.process(order_changes(spark, sf_dir))
    return engine.results["least"]


register("view_delta_merge", delta_merge, f"WITH {FOLDED} SELECT segment, round(sum(value) / count(*), 7) AS value FROM folded GROUP BY 1")
register("view_delta_min", delta_least, f"WITH {FOLDED} SELECT segment, min(value) AS value FROM folded GROUP BY 1")
SQL_VIEW = "SELECT v.segment, count(*) AS orders, sum(CASE WHEN e.label = 'placed' THEN 1 ELSE 0 END) AS placed FROM vertices v JOIN edges e ON e.src = v.id WHERE v.type = 'Customer' GROUP BY v.segment"
register("sql_view", lambda s, d: sqlviews.run(star_graph(s, d), SQL_VIEW), f"WITH {STAR_E} SELECT c_mktsegment AS segment, count(*) AS orders, CAST(sum(CASE WHEN e.label = 'placed' THEN 1 ELSE 0 END) AS BIGINT) AS placed FROM customer JOIN e ON e.src = {3 * SPAN} + c_custkey GROUP BY 1")

# windows

MEASURES = [windows.Measure(f, None if f == "count" else "value", f) for f in ("count", "sum", "average", "min", "max")]
M_SQL = "count(*) AS count, round(sum(value), 7) AS sum, round(sum(value) / count(*), 7) AS average, min(value) AS min, max(value) AS max"


def _ntz(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end") if c in df.columns})


def _window(window, measures=None, keys=(), order=None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _ntz(windows.windowed(read(spark, sf_dir, "events"), window, measures or MEASURES, keys, order=order))
        return rounded(found, *(c for c in ("sum", "average") if c in found.columns), digits=7)

    return run


BUCKET = "time_bucket(INTERVAL '1 hour', ts)"
register("win_tumbling", _window(windows.Tumbling("1 hour")), f"SELECT {BUCKET} AS window_start, {BUCKET} + INTERVAL '1 hour' AS window_end, {M_SQL} FROM events GROUP BY 1, 2")
register("win_tumbling_keyed", _window(windows.Tumbling("1 day"), keys=("event_type",)), f"SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS window_start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS window_end, {M_SQL} FROM events GROUP BY 1, 2, 3")
register(
    "win_sliding",
    _window(windows.Sliding("1 hour", "30 minutes")),
    f"WITH w AS (SELECT time_bucket(INTERVAL '30 minutes', ts) - k * INTERVAL '30 minutes' AS window_start, value FROM events, (VALUES (0), (1)) AS s(k)) SELECT window_start, window_start + INTERVAL '1 hour' AS window_end, {M_SQL} FROM w GROUP BY 1",
)
register(
    "win_session",
    _window(windows.Session("30 minutes"), keys=("user_id",)),
    "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events), "
    f"s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g) SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL '30 minutes' AS window_end, {M_SQL} FROM s GROUP BY user_id, n",
)
register("win_count", _window(windows.Count(50), order="event_id"), f"WITH r AS (SELECT *, (row_number() OVER (ORDER BY ts, event_id) - 1) // 50 AS window_number FROM events) SELECT window_number, min(ts) AS window_start, max(ts) AS window_end, {M_SQL} FROM r GROUP BY 1")
register("win_count_keyed", _window(windows.Count(10), keys=("user_id",), order="event_id"), f"WITH r AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS window_number FROM events) SELECT user_id, window_number, min(ts) AS window_start, max(ts) AS window_end, {M_SQL} FROM r GROUP BY 1, 2")
register("win_global", _window(windows.Global()), f"SELECT {M_SQL} FROM events")
register("win_distinct", _window(windows.Tumbling("1 hour"), [windows.Measure("distinct", "event_type", "kinds")]), f"SELECT {BUCKET} AS window_start, {BUCKET} + INTERVAL '1 hour' AS window_end, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1, 2")
register(
    "win_custom",
    _window(windows.Tumbling("1 day"), [windows.Measure("custom", name="spread", custom=lambda f: round(f["value"].max() - f["value"].min(), 6))]),
    "SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS window_end, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1, 2",
)


def streamed_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly windows again, by a stream over the events' files."""
    stream = replay(spark, sf_dir, read(spark, sf_dir, "events").schema, pattern="events.parquet")
    found = windows.windowed(stream, windows.Tumbling("1 hour"), [windows.Measure("count"), windows.Measure("distinct", "event_type", "kinds")])
    return _ntz(drained(found))


register("stream_tumbling", streamed_tumbling, f"SELECT {BUCKET} AS window_start, {BUCKET} + INTERVAL '1 hour' AS window_end, count(*) AS count, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1, 2")


def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = replay(spark, sf_dir, read(spark, sf_dir, "events").schema, pattern="events.parquet")
    return drained(windows.streaming_count_windows(stream, 10, "user_id", "value"), "append").select("user_id", "window_number", "count")


register("stream_count_windows", streamed_counts, "SELECT user_id, unnest(range(count(*) // 10)) AS window_number, CAST(10 AS BIGINT) AS count FROM events GROUP BY user_id")

# stages

RULES = (
    transform.Rule("event_type", "not_equals", "error"),
    transform.Rule("value", "less_than", 5.0, "drop"),
    transform.Rule("event_type", "in", ("purchase", "signup"), "modify", "tier", "gold"),
    transform.Rule("props", "contains", '"k"'),
)
register("filter_rules", lambda s, d: transform.apply_rules(read(s, d, "events"), list(RULES)).select("event_id", "event_type", "value", "tier"), "SELECT event_id, event_type, value, CASE WHEN event_type IN ('purchase', 'signup') THEN 'gold' END AS tier FROM events WHERE event_type <> 'error' AND NOT value < 5.0 AND contains(props, '\"k\"')")


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency to a fixed time, and places of addresses made of the user's number."""
    address = F.concat(F.element_at(F.array(F.lit("192.168."), F.lit("10.0."), F.lit("8.8.")), (F.col("user_id") % 3 + 1).cast("int")), F.col("user_id").cast("string"), F.lit(".1"))
    stages = transform.pipeline(transform.latency_stage(now=F.lit("2024-02-01 00:00:00").cast("timestamp")), transform.place_stage())
    return stages(read(spark, sf_dir, "events").withColumn("ip_address", address)).select("event_id", "latency_ms", *transform.PLACE_FIELDS)


register(
    "enrich_latency_place",
    enriched,
    "SELECT event_id, epoch_ms(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts) // 1000 AS latency_ms, CASE WHEN user_id % 3 < 2 THEN 'Local' ELSE 'Unknown' END AS geo_country, CASE user_id % 3 WHEN 0 THEN 'Internal' WHEN 1 THEN 'Private' ELSE 'Unknown' END AS geo_region, CASE user_id % 3 WHEN 0 THEN 'Office' WHEN 1 THEN 'Datacenter' ELSE 'Unknown' END AS geo_city, CAST(CASE user_id % 3 WHEN 0 THEN 37.7749 WHEN 1 THEN 40.7128 ELSE 0 END AS DOUBLE) AS geo_latitude, CAST(CASE user_id % 3 WHEN 0 THEN -122.4194 WHEN 1 THEN -74.0060 ELSE 0 END AS DOUBLE) AS geo_longitude FROM events",
)


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = transform.Extraction(
        "add_edge",
        (transform.FieldMap("src", "user_id"), transform.FieldMap("dst", "props", "extract", r'"k": (\d+)'), transform.FieldMap("label", "event_type", "map", {"view": "viewed", "purchase": "bought"})),
        (transform.FieldMap("weight", "value", "convert", "double"),),
        (transform.Rule("event_type", "in", ("view", "purchase")),),
    )
    found = transform.extract_changes(read(spark, sf_dir, "events"), [maps], "event_id")
    return found.select("seq", "op", "src", "dst", "label", F.col("after")["weight"].cast("double").alias("weight"))


register("extract_changes", extracted, "SELECT event_id AS seq, 'add_edge' AS op, user_id AS src, CAST(regexp_extract(props, '\"k\": (\\d+)', 1) AS BIGINT) AS dst, CASE event_type WHEN 'view' THEN 'viewed' ELSE 'bought' END AS label, value AS weight FROM events WHERE event_type IN ('view', 'purchase')")
register("event_metrics", lambda s, d: rounded(_ntz(alerts.event_metrics(read(s, d, "events"), "1 hour")), "rate", digits=8), f"SELECT {BUCKET} AS window_start, {BUCKET} + INTERVAL '1 hour' AS window_end, event_type, count(*) AS events, round(count(*) / 3600.0::DOUBLE, 8) AS rate FROM events GROUP BY 1, 2, 3")
ALERTS = [alerts.AlertRule("busy", (alerts.Condition("events", ">", 4.0), alerts.Condition("rate", ">=", 0.002, "error"))), alerts.AlertRule("pairs", (alerts.Condition("events", "=", 2.0, "view"),))]
register(
    "alert_rules",
    lambda s, d: _ntz(alerts.alerts(alerts.event_metrics(read(s, d, "events"), "1 hour"), ALERTS)).select("rule", "window_start", "event_type", "events"),
    f"WITH m AS (SELECT {BUCKET} AS window_start, event_type, count(*) AS events FROM events GROUP BY 1, 2) SELECT 'busy' AS rule, window_start, event_type, events FROM m WHERE events > 4 OR (event_type = 'error' AND events / 3600.0 >= 0.002) UNION ALL SELECT 'pairs', window_start, event_type, events FROM m WHERE event_type = 'view' AND events = 2",
)
register(
    "late_events",
    lambda s, d: windows.late_events(read(s, d, "events").withColumn("arrival", F.col("ts") + F.make_dt_interval(mins=(F.col("event_id") * 7 % 50).cast("int"))), "30 minutes"),
    "WITH a AS (SELECT *, ts + INTERVAL 1 minute * (event_id * 7 % 50) AS arrival FROM events), m AS (SELECT *, max(ts) OVER (ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM a) SELECT count(*) AS events, CAST(count(*) FILTER (ts < most - INTERVAL '30 minutes') AS BIGINT) AS late FROM m",
)
