import datetime as dt

import pytest
from pyspark.sql import functions as F

from graphloom.plans import maintenance, views
from graphloom.sources import streams
from graphloom.sources.changelog import as_changes
from graphloom.sources.shared import new_dir
from graphloom.streaming import alerts, processor, transform, windows
from tests.graphs import graph

S2 = [("user_login", 1000), ("page_view", 1005), ("click_event", 1010), ("page_view", 1015), ("user_logout", 1020), ("user_login", 1030)]


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def events(spark):
    rows = [(f"e{k}", kind, at(t), "web" if k % 2 else None, 10 * k, {"ip": "10.1.1.1", "k": str(k)}, float(k) if k else None) for k, (kind, t) in enumerate(S2)]
    return spark.createDataFrame(rows, "event_id string, event_type string, ts timestamp_ntz, source string, priority int, metadata map<string,string>, value double")


def test_windows(events):
    every = [windows.Measure(f, None if f == "count" else "value", f) for f in ("count", "sum", "average", "min", "max", "distinct")]
    one = windows.windowed(events, windows.Tumbling("10 minutes"), every).first()
    assert (one["count"], one["sum"], one["average"], one["min"], one["max"], one["distinct"]) == (6, 15.0, 2.5, 1.0, 5.0, 5)
    assert windows.windowed(events, windows.Session("9 seconds")).count() == 2
    assert sorted(r["count"] for r in windows.windowed(events, windows.Count(4), order="event_id").collect()) == [2, 4]
    assert windows.windowed(events, windows.Sliding("20 seconds", "10 seconds")).agg(F.sum("count")).first()[0] == 12
    kinds = {r.event_type: r["count"] for r in windows.windowed(events, windows.Global(), keys=("event_type",)).collect()}
    assert kinds == {"user_login": 2, "page_view": 2, "click_event": 1, "user_logout": 1}
    nothing = windows.windowed(events.where("value is null"), windows.Global(), [windows.Measure("min", "value", "m")]).first()
    assert nothing["m"] == 0.0


def written(spark, df, name):
    path = new_dir(spark, name)
    df.repartitionByRange(3, "ts").write.parquet(path)
    return path


def test_stream_equals_batch(spark, events):
    stream = streams.replay(spark, written(spark, events, "in"), events.schema)
    spec = windows.Tumbling("20 seconds"), [windows.Measure("count"), windows.Measure("distinct", "event_type", "kinds")]
    assert sorted(map(tuple, processor.drained(windows.windowed(stream, *spec)).collect())) == sorted(map(tuple, windows.windowed(events, *spec).collect()))


def test_stream_drops_repeats(spark, events):
    path = written(spark, events.unionByName(events), "in")
    kept = processor.drained(processor.deduplicated(streams.replay(spark, path, events.schema, 9), "1 hour"), "append")
    assert kept.count() == 6


def test_stream_maintains_views(spark):
    log = as_changes(spark, [{"seq": k, "op": "add_vertex", "id": k, "after": {"value": k}} for k in range(1, 8)] + [{"seq": 9, "op": "remove_vertex", "id": 7}])
    path = new_dir(spark, "log")
    log.coalesce(1).write.parquet(path)
    engine = maintenance.Engine(graph(spark, [], "id long, type string, value double", []))
    engine.register(views.View("sum", views.Aggregation("sum")))
    processor.maintain(streams.replay(spark, path, log.schema), engine, new_dir(spark, "marks")).awaitTermination()
    assert engine.results["sum"].first()["value"] == 21.0


@pytest.mark.parametrize(
    ("rule", "kept"),
    [
        (("event_type", "equals", "page_view"), [1, 3]), (("event_type", "not_equals", "page_view"), [0, 2, 4, 5]), (("priority", "greater_than", 30), [4, 5]),
        (("priority", "less_than", 10), [0]), (("event_type", "contains", "user"), [0, 4, 5]), (("event_type", "not_contains", "user"), [1, 2, 3]),
        (("k", "in", ("1", "2")), [1, 2]), (("k", "not_in", ("1", "2")), [0, 3, 4, 5]), (("source", "exists"), [1, 3, 5]), (("source", "not_exists"), [0, 2, 4]), (("nowhere", "equals", 1), []), (("nowhere", "not_equals", "1"), [0, 1, 2, 3, 4, 5]),
    ],
)
def test_rules(events, rule, kept):
    names = lambda df: sorted(int(r.event_id[1:]) for r in df.collect())
    assert names(transform.apply_rules(events, [transform.Rule(*rule)])) == kept
    dropped = transform.Rule(*rule, *([None] if len(rule) == 2 else []), "drop")
    assert names(transform.apply_rules(events, [dropped])) == [k for k in range(6) if k not in kept]


def test_stages(events):
    stages = transform.pipeline(
        transform.rules_stage(transform.Rule("priority", "greater_than", 25, "modify", "priority", 99), transform.Rule("k", "equals", "0", "modify", "tag", "first")),
        lambda df: df.withColumn("ip_address", F.col("metadata")["ip"]), transform.place_stage(), transform.latency_stage(now=F.lit(at(1031)).cast("timestamp")),
    )
    rows = {r.event_id: r for r in stages(events).collect()}
    assert rows["e5"].priority == 99 and rows["e1"].priority == 10 and rows["e0"].metadata["tag"] == "first"
    assert rows["e5"].latency_ms == 1000 and rows["e2"].geo_city == "Datacenter" and rows["e2"].geo_latitude == 40.7128


def test_decoding(spark):
    rows = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, "no")], "id long, value string")
    assert [tuple(r) for r in streams.decode(rows, "json", "a int, b string").orderBy("id").collect()] == [(1, 1, "x"), (2, None, None)]
    assert streams.decode(spark.createDataFrame([("3,y",)], "value string"), "csv", "a int, b string").first() == (3, "y")
    assert streams.decode(spark.createDataFrame([("<r><a>4</a></r>",)], "value string"), "xml", "a int").first()[0] == 4
    with pytest.raises(ValueError):
        streams.decode(rows, "avro", "a int")


def test_alerts(events):
    rules = [alerts.AlertRule("logins", (alerts.Condition("events", "=", 2.0, "user_login"),), 60), alerts.AlertRule("any", (alerts.Condition("events", ">", 9), alerts.Condition("rate", "<", 0.02)))]
    metrics = alerts.event_metrics(events, "60 seconds")
    told, now = [], [0.0]
    book = alerts.AlertBook(rules, [told.append], lambda: now[0])
    fresh = book.feed(metrics)
    assert {a["rule"] for a in fresh} == {"any", "logins"} or {a["rule"] for a in fresh} == {"any"}
    before = len(book.entries)
    logins = [a for a in book.entries if a["rule"] == "logins"]
    now[0] = 10.0
    book.feed(metrics)
    assert sum(a["rule"] == "logins" for a in book.entries) == len(logins)
    assert book.resolve(1) and not book.resolve(1) and len(book.open()) == len(book.entries) - 1 and len(told) == len(book.entries) >= before
    kept = alerts.after_cooldown(alerts.alerts(metrics, [alerts.AlertRule("any", (alerts.Condition("events", ">", 0),), 3600)]), [alerts.AlertRule("any", (), 3600)])
    assert kept.count() == 1


def test_late(spark):
    rows = [(at(t), at(a)) for t, a in ((0, 1), (100, 101), (20, 102), (90, 103), (4000, 4001), (3000, 4002))]
    found = windows.late_events(spark.createDataFrame(rows, "ts timestamp_ntz, arrival timestamp_ntz"), "30 seconds").first()
    assert tuple(found) == (6, 2)


def test_source_manager():
    class Query:
        def __init__(self):
            self.isActive, self.error, self.lastProgress, self.recentProgress = True, None, None, []

        def exception(self):
            return self.error

        def stop(self):
            self.isActive = False

    manager, made = streams.SourceManager(most=2), []
    manager.add("a", lambda: made.append(Query()) or made[-1])
    manager.add("b", Query)
    with pytest.raises(OverflowError):
        manager.add("c", Query)
    assert manager.status("a") == "stopped"
    manager.start("a")
    made[-1].isActive, made[-1].error = False, RuntimeError()
    assert manager.status("a") == "failed" and manager.check() == {"a": "running", "b": "stopped"} and len(made) == 2
    manager.remove("a")
    assert manager.check() == {"b": "stopped"}
