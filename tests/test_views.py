import pytest
from pyspark.sql import functions as F

from graphloom.functions.predicates import QueryError
from graphloom.plans import maintenance, router, sqlviews, views
from graphloom.service import GraphService
from graphloom.sources.changelog import as_changes, fold
from graphloom.sources.shared import new_dir
from graphloom.sources.store import Conflict, GraphStore
from tests.graphs import graph, people, plain

VERTICES, EDGES = "id long, type string, name string, value double", "src long, dst long, label string, weight double"


def empty(spark):
    return graph(spark, [], VERTICES, [], EDGES)


def changes(spark, *rows):
    return as_changes(spark, [{"seq": k, **r} for k, r in enumerate(rows, 1)])


def add(i, **props):
    return {"op": "add_vertex", "id": i, "after": props}


def test_fold(spark):
    start = graph(spark, [(1, "A", "a", 1.0), (2, "A", "b", 2.0), (3, "A", "c", 3.0)], VERTICES, [(1, 2, "x", 1.0), (2, 3, "x", 2.0), (1, 3, "y", 3.0)], EDGES)
    log = changes(
        spark,
        {"op": "add_edge", "src": 2, "dst": 1, "label": "z", "after": {"weight": 9}},
        {"op": "remove_vertex", "id": 2},
        add(2, name="again"),
        {"op": "add_edge", "src": 2, "dst": 3, "label": "new", "after": {}},
        {"op": "update_edge", "src": 1, "dst": 3, "label": "y", "after": {"weight": 7.5}},
        {"op": "update_edge", "src": 1, "dst": 2, "label": "x", "after": {"weight": 1}},
        {"op": "remove_edge", "src": 9, "dst": 9, "label": "x"},
        {"op": "update_vertex", "id": 8, "after": {"value": 5}},
        {"op": "remove_vertex", "id": 3},
        {"op": "add_edge", "src": 1, "dst": 3, "label": "y", "after": {"weight": 4}},
        {"op": "remove_edge", "src": 1, "dst": 3, "label": "y"},
        {"op": "update_edge", "src": 1, "dst": 3, "label": "y", "after": {"weight": 6}},
    )
    out = fold(start, log)
    assert sorted((r.id, r.name, r.value) for r in out.vertices.collect()) == [(1, "a", 1.0), (2, "again", None), (8, None, 5.0)]
    assert out.edges.collect() == []
    half = fold(start, log.where("seq <= 6"))
    assert sorted((r.src, r.dst, r.label, r.weight) for r in half.edges.collect()) == [(1, 3, "y", 7.5), (2, 3, "new", None)]


def test_engine_counts_sums_and_extremes(spark):
    engine = maintenance.Engine(empty(spark))
    for name in ("count", "sum", "min", "max", "avg"):
        engine.register(views.View(name, views.Aggregation(name)))
    engine.register(views.View("parts", views.Analytics("connectivity")))
    engine.register(views.View("known", views.Lookup((1, 2))))
    value = lambda n: engine.results[n].first()["value"]
    engine.process(changes(spark, add(1, value=10), add(2, value=20)), batch_id=0)
    assert [value(n) for n in ("count", "sum", "min", "max", "avg")] == [2, 30, 10, 20, 15]
    updated = {u.view for u in engine.process(as_changes(spark, [{"seq": 3, **add(3)}, {"seq": 4, "op": "add_edge", "src": 1, "dst": 2, "label": "x"}]), batch_id=1)}
    assert updated == {"count", "sum", "min", "max", "avg", "parts"}
    assert [value(n) for n in ("count", "sum", "avg", "parts")] == [3, 30, 10, 2]
    assert engine.process(as_changes(spark, [{"seq": 3, **add(4)}]), batch_id=1) == []
    engine.process(as_changes(spark, [{"seq": 5, "op": "remove_vertex", "id": 1}]))
    assert [value(n) for n in ("count", "min", "parts")] == [2, 20, 2]
    assert engine.results["known"].count() == 1 and engine.metrics()["views"] == 7


@pytest.mark.parametrize(
    ("kind", "want"),
    [(views.Lookup((1, 2)), [True, False, False]), (views.Lookup(), [True, True, False]), (views.Aggregation("count"), [True, True, False]), (views.Analytics("triangle_count"), [False, False, True]), (views.Analytics("connectivity"), [True, True, True]), (views.SqlQuery("SELECT count(*) FROM edges"), [False, False, True])],
)
def test_impact(spark, kind, want):
    log = [changes(spark, r) for r in (add(1), add(99), {"op": "add_edge", "src": 1, "dst": 2, "label": "x"})]
    assert [not maintenance.relevant(kind, c).isEmpty() for c in log] == want


def test_dependencies():
    d = maintenance.Dependencies()
    d.add("v3", ("v1", "v2"))
    d.add("v4", ("v3",))
    order = d.order()
    assert order.index("v1") < order.index("v3") < order.index("v4") and d.pending() == []
    d.mark("v2")
    assert d.pending() == ["v2", "v3", "v4"]
    with pytest.raises(ValueError):
        d.add("v1", ("v4",))
    assert d.dependents("v4") == set()


def test_refresh_rules():
    assert views.Refresh("demand", ttl=10).due(0, 11) and not views.Refresh("demand", ttl=10).due(5, 11)
    assert views.Refresh("interval", interval=5).due(0, 5) and not views.Refresh("event", debounce=1).due(0, 99)
    assert not views.Refresh("hybrid", interval=1, on_event=True).due(0, 9) and views.Refresh("hybrid", interval=1).due(0, 9)
    for bad in (views.View("x", views.Lookup(), views.Refresh("event")), views.View("x", views.Lookup(), views.Refresh("interval", interval=0.01)), views.View("x", views.Lookup(), memory_mb=0)):
        with pytest.raises(ValueError):
            bad.validate()
    with pytest.raises(QueryError):
        views.View("x", views.Aggregation("count_by_role")).validate()


def test_registry(spark, tmp_path):
    clock = [100.0]
    registry = views.Registry(str(tmp_path), clock=lambda: clock[0])
    g = people(spark)
    registry.register(views.View("old", views.Hybrid((views.Aggregation("count", ("department",)), views.Lookup((1,)))), views.Refresh("demand", ttl=5)))
    with pytest.raises(ValueError):
        registry.register(views.View("old", views.Lookup()))
    assert registry.refresh_due(g) == ["old"] and registry.refresh_due(g) == []
    counts, rows = registry.data(spark, "old")
    assert {r.department: r.value for r in counts.collect()} == {"Engineering": 3.0, "Marketing": 1.0} and rows.count() == 1
    again = views.Registry(str(tmp_path))
    assert again.load() == 1 and again.get("old") == registry.get("old")
    clock[0] = 106.0
    assert registry.refresh_due(g) == ["old"]
    registry.delete("old")
    assert views.Registry(str(tmp_path)).load() == 0


def test_router():
    r = router.Router()
    for view in (views.View("l", views.Lookup((1, 2, 3))), views.View("c", views.Aggregation("count")), views.View("p", views.Analytics("pagerank")), views.View("q", views.SqlQuery("SELECT * FROM vertices"))):
        r.add(view)
    assert (r.route(router.VertexLookup((1, 2))).view, r.route(router.VertexLookup((1, 2))).confidence) == ("l", 100)
    assert r.route(router.VertexLookup((1, 9, 8))).view == "q"
    assert r.route(router.AggregateQuery("count")).confidence == 95 and r.route(router.AnalyticsQuery("pagerank")).confidence == 90
    assert r.route(router.PropertySearch((("a", 1),))).view == "q"
    assert r.route(router.HybridQuery((router.AggregateQuery("count"), router.VertexLookup((9,))))).view == "c"
    r.timed("l", 50.0)
    r.timed("l", 30.0)
    assert r.latency("l") == 40.0
    with pytest.raises(router.NoView):
        router.Router().route(router.AggregateQuery("count"))


def test_cache():
    clock = [0.0]
    level = router.Level("L1", 5, 10, "lru", lambda: clock[0])
    for k in range(5):
        assert level.put(str(k), k, 1)
    assert level.get("0") == 0
    level.put("5", 5, 1)
    assert level.get("1") is None and level.get("0") == 0 and level.evictions == 1
    clock[0] = 11
    assert level.get("0") is None and not level.put("big", 1, 6)
    often = router.Level("L3", 2, 99, "lfu", lambda: 0.0)
    often.put("a", 1, 1), often.put("b", 2, 1), often.get("a"), often.put("c", 3, 1)
    assert often.get("b") is None and often.get("a") == 1
    cache = router.ViewCache(lambda: 0.0)
    assert cache.put("v", "k", [1], views.Lookup(), 2000, 100) == "L1" and cache.put("w", "k", [2], views.SqlQuery("x"), 0, 200 << 20) == "L3"
    assert cache.get("v", "k") == [1] and cache.get("x", "k") is None
    assert cache.stats()["all"] == {"hits": 1, "misses": 3, "hit_ratio": 0.25}
    cache.clear()
    assert cache.get("v", "k") is None


def test_service(spark, tmp_path):
    service = GraphService(people(spark), views.Registry(str(tmp_path)))
    service.create_view(views.View("n", views.Aggregation("count")))
    for _ in range(2):
        assert service.answer(router.AggregateQuery("count")).first()["value"] == 4.0
    assert service.cache.stats()["all"]["hits"] == 1 and service.run("VIEW LIST") == ["n"]
    assert service.run("CACHE WARM") == 1 and service.run("STATS")["edges"] == 3
    assert [r.id for r in service.recommendations(1, 5).collect()] == [3, 4]
    assert [r["rank"] for r in service.influence(2).collect()] == [1, 2] and service.communities().count() == 4
    assert service.run("SQL SELECT count(*) AS n FROM edges").first()["n"] == 3


@pytest.mark.parametrize("text", ["SELECT id FROM vertices; SELECT 1 FROM edges", "DELETE FROM vertices", "SELECT * FROM users", "SELECT * FROM vertices LIMIT 3", "SELECT DISTINCT id FROM vertices", "SELECT 1", "SELECT * FROM vertices v JOIN secrets s ON true", "SELECT * FROM vertices, other", "CREATE VIEW v AS SELECT * FROM nowhere", "", "SELECT * FROM (SELECT * FROM hidden) x"])
def test_refused_sql(text):
    with pytest.raises(QueryError):
        sqlviews.validate(text)


def test_accepted_sql(spark):
    g = people(spark)
    assert sqlviews.relations("SELECT extract(year FROM x), 'from y' FROM vertices v, edges e JOIN edge f ON v.id = f.src WHERE a IS DISTINCT FROM b") == ["vertices", "edges", "edge"]
    assert sqlviews.run(g, "CREATE VIEW x AS WITH t AS (SELECT src FROM edges) SELECT v.name, count(*) AS n FROM vertex v JOIN t ON t.src = v.id GROUP BY v.name").count() == 2


def test_store(spark):
    store = GraphStore(spark, new_dir(spark, "store"), VERTICES, EDGES)
    heard = []
    store.listeners.append(lambda c: heard.append(c.count()))
    assert store.commit(store.begin().add_vertex(1, name="a", value=1.5).add_vertex(2).add_edge(1, 2, "x", weight=2.0)) == 3
    first, second = store.begin(), store.begin()
    assert store.commit(first.update_vertex(2, name="b")) == 4
    with pytest.raises(Conflict):
        store.commit(second.remove_vertex(1))
    store.rollback(second)
    assert second.operations == [] and store.stats() == {"vertices": 2, "edges": 1, "version": 4} and heard == [3, 1]
    assert store.graph(3).vertices.where("id = 2").first()["name"] is None
    made = store.execute("CREATE (a:User {name: 'x'})-[:knows {weight: 3.5}]->(b:User), (b)<-[:likes]-(a)")
    assert sorted(r.id for r in made.collect()) == [3, 4]
    again = GraphStore(spark, store.path, VERTICES, EDGES)
    assert sorted((r.src, r.dst, r.label, r.weight) for r in again.graph().edges.collect()) == [(1, 2, "x", 2.0), (3, 4, "knows", 3.5), (3, 4, "likes", None)]
    again.checkpoint()
    assert again.snapshots() == [again.version()]
    assert [r.id for r in again.execute("MATCH (a)-[:knows]->(b) DELETE b").collect()] == [4]
    assert {r.id for r in again.graph().vertices.collect()} == {1, 2, 3} and again.graph().edges.count() == 1
    for k in range(2):
        again.commit(again.begin().add_vertex(10 + k))
    assert again.version() == 11 and again.graph().vertices.count() == 5


def test_store_after_a_dead_writer(spark):
    store = GraphStore(spark, new_dir(spark, "store"), VERTICES, EDGES)
    store.commit(store.begin().add_vertex(1))
    target, fs = store._hadoop(f"{store.path}/commits/{1:020d}")
    fs.create(target, False).close()  # created, never filled
    assert store.version() == 1 and store.graph().vertices.count() == 1
    with pytest.raises(Conflict):
        store.commit(store.begin().add_vertex(2))
    fs.setTimes(target, 1_000_000, -1)
    assert store.commit(store.begin().add_vertex(2)) == 2
    assert store.version() == 2 and store.graph().vertices.count() == 2 and store.graph(1).vertices.count() == 1
    assert store.changes(1).count() == 1
