import collections
import random
import time

import pytest
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph
from graphloom.operators import algorithms as A
from graphloom.operators import shapes as S
from graphloom.operators import traverse as V
from graphloom.operators.ranked import running_rank
from tests.graphs import WEB, graph, people, plain


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_neighbours(spark):
    g = people(spark)
    assert ids(V.out_neighbors(g, 2), "neighbor") == [3, 4] and ids(V.in_neighbors(g, 2), "neighbor") == [1]
    assert V.all_neighbors(g, 2).count() == 3 and ids(V.out_neighbors(g, 2, "friend"), "neighbor") == [3]
    assert ids(V.two_hop(g, 1, "friend")) == [3] and ids(V.two_hop(g, 1)) == [3, 4]
    assert V.edges_between(g, 3, 2).count() == 1 and g.edge(2, 4).first()["label"] == "colleague"
    assert V.all_neighbors(plain(spark, [(1, 1)]), 1).count() == 2


def test_shortest_paths(spark):
    g = people(spark)
    assert V.shortest_path(g, 1, 3, 5) == [1, 2, 3] and V.shortest_path(g, 1, 1, 5) == [1]
    assert V.shortest_path(g, 3, 1, 5) is None and V.shortest_path(g, 1, 3, 1) is None
    assert V.shortest_path(plain(spark, [(1, 3), (1, 2), (2, 4), (3, 4)]), 1, 4, 5) == [1, 2, 4]


def test_measures(spark):
    g = plain(spark, [(1, 2, "mentors"), (4, 5, "mentors"), (2, 3, "r"), (3, 4, "m"), (1, 4, "c"), (1, 5, "c")])
    assert V.density(g).first()["density"] == pytest.approx(0.3)
    assert V.average_degree(g).first()[0] == pytest.approx(12 / 5)
    assert {r.id: r.degree for r in V.degrees(g).collect()} == {1: 3, 2: 2, 3: 2, 4: 3, 5: 2}
    assert ids(V.most_connected(g)) == [1, 4]
    assert {tuple(r) for r in V.common_neighbors(g).collect()} == {(1, 3, 2), (2, 4, 2), (2, 5, 1), (3, 5, 1)}


def test_pagerank_against_a_loop(spark):
    g = plain(spark, WEB, extra=[9])
    out = collections.Counter(a for a, _ in WEB)
    score = dict.fromkeys([1, 2, 3, 4, 5, 6, 7, 9], 1 / 8)
    for _ in range(20):
        score = {v: 0.15 / 8 + 0.85 * sum(score[a] / out[a] for a, b in WEB if b == v) for v in score}
    got = A.pagerank(g, iterations=20, tolerance=None)
    assert {r.id: r.score for r in got.scores.collect()} == pytest.approx(score)
    assert sum(score.values()) < 1 and got.iterations == 20
    stopped = A.pagerank(g, tolerance=0.02)
    assert stopped.iterations < 20 and stopped.delta < 0.02
    assert [r.id for r in stopped.top(1).collect()] == [5] and stopped.score(77) is None


def reach(edges):
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
    out = {}
    for v in {x for e in edges for x in e}:
        seen, todo = set(), [v]
        while todo:
            for w in near[todo.pop()] - seen:
                seen.add(w)
                todo.append(w)
        out[v] = seen
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(rng.randrange(24), rng.randrange(24)) for _ in range(34)})
    g, far = plain(spark, edges, extra=[99]), reach(edges)
    assert {tuple(r) for r in A.reachability(g).collect()} == {(u, v) for u in far for v in far[u]}
    strong = {v: min([v, *(w for w in far[v] if v in far[w])]) for v in far} | {99: 99}
    assert {r.id: r.component for r in A.strongly_connected(g).collect()} == strong
    both = reach(edges + [(b, a) for a, b in edges])
    assert {r.id: r.component for r in A.connected_components(g).collect()} == {v: min(both[v] | {v}) for v in both} | {99: 99}
    links = {frozenset(e) for e in edges if e[0] != e[1]}
    want = sorted((a, b, c) for a in range(24) for b in range(a + 1, 24) for c in range(b + 1, 24) if {frozenset((a, b)), frozenset((b, c)), frozenset((a, c))} <= links)
    assert sorted(tuple(r) for r in A.triangles(g).collect()) == want
    core, left = edges, None
    while left != core:
        left = core
        ends = collections.Counter(x for e in core for x in e)
        core = [e for e in core if ends[e[0]] >= 3 and ends[e[1]] >= 3]
    assert sorted((r.src, r.dst) for r in A.k_core(g, 3).collect()) == core
    start = edges[0][0]
    levels = {start: 0}
    todo = [start]
    for v in todo:
        for a, b in edges:
            if a == v and b not in levels:
                levels[b] = levels[v] + 1
                todo.append(b)
    assert {r.id: r.hops for r in A.bfs_levels(g, start).collect()} == levels


def test_weighted_paths(spark):
    rows = [(1, 2, "a", 4.0), (1, 3, "a", 1.0), (3, 2, "a", 2.0), (2, 4, "a", None), (1, 4, "b", 9.0), (3, 2, "b", 5.0)]
    g = graph(spark, [(i,) for i in range(1, 6)], "id long", rows, "src long, dst long, label string, weight double")
    found = A.shortest_distances(g, 1)
    assert {r.id: r.distance for r in found.collect()} == {1: 0.0, 3: 1.0, 2: 3.0, 4: 4.0}
    assert A.path_to(found, 1, 4) == [1, 3, 2, 4] and A.path_to(found, 1, 5) is None
    assert A.path_exists(g, 1, 4) and not A.path_exists(g, 4, 1)
    bad = graph(spark, [(1,)], "id long", [(1, 2, "a", -1.0)], "src long, dst long, label string, weight double")
    with pytest.raises(ValueError):
        A.shortest_distances(bad, 1)


def test_centralities(spark):
    g = plain(spark, [(1, 2, "a"), (1, 2, "b"), (2, 3, "a"), (3, 1, "a"), (3, 4, "a")])
    assert {r.id: r.centrality for r in A.degree_centrality(g).collect()} == pytest.approx({1: 2 / 6, 2: 2 / 6, 3: 3 / 6, 4: 1 / 6})
    assert {r.id: r.coefficient for r in A.clustering(g).collect()} == pytest.approx({1: 1.0, 2: 1.0, 3: 1 / 3, 4: 0.0})
    assert {r.id: r.closeness for r in A.closeness(g).collect()} == pytest.approx({1: 3 / 6, 2: 3 / 5, 3: 3 / 4, 4: 0.0})


def test_running_rank_over_partitions(spark, monkeypatch):
    monkeypatch.setattr("graphloom.operators.ranked.PARTITION_ROWS", 10)
    rows = running_rank(spark.range(95).withColumn("k", F.xxhash64("id")), [F.col("k")]).collect()
    assert [r["rank"] for r in sorted(rows, key=lambda r: r["k"])] == list(range(95))


def test_betweenness_and_eigenvector_against_loops(spark):
    rng = random.Random(5)
    edges = sorted({(rng.randrange(12), rng.randrange(12)) for _ in range(26)} | {(0, 1), (1, 2)})
    near = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
    ids_ = sorted({x for e in edges for x in e})
    hops, paths = {}, {}
    for s in ids_:
        hops[s], paths[s], todo = {s: 0}, collections.Counter({s: 1}), [s]
        for v in todo:
            for w in near[v]:
                if w not in hops[s]:
                    hops[s][w] = hops[s][v] + 1
                    todo.append(w)
                if hops[s][w] == hops[s][v] + 1:
                    paths[s][w] += paths[s][v]
    want = dict.fromkeys(ids_, 0.0)
    for s in ids_:
        for t in hops[s]:
            for v in hops[s]:
                if v not in (s, t) and s != t and t in hops[v] and hops[s][v] + hops[v][t] == hops[s][t]:
                    want[v] += paths[s][v] * paths[v][t] / paths[s][t]
    g = plain(spark, edges)
    assert {r.id: r.betweenness for r in A.betweenness(g).collect()} == pytest.approx(want)
    score = dict.fromkeys(ids_, 1.0)
    for _ in range(30):
        score = {v: score[v] + sum(score[a] for a, b in edges if b == v) for v in ids_}
        length = sum(x * x for x in score.values()) ** 0.5
        score = {v: x / length for v, x in score.items()}
    got = A.eigenvector(g, iterations=30, tolerance=None)
    assert {r.id: r.score for r in got.scores.collect()} == pytest.approx(score)
    assert A.eigenvector(g, tolerance=1e-3).iterations < 100


def test_shapes(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 1), (1, 3), (5, 5), (6, 7), (7, 6)]
    g = plain(spark, edges, extra=[9])

    def walks(length):
        out = [[a, b] for a, b in edges if a != b]
        for _ in range(length - 1):
            out = [[*p, b] for p in out for a, b in edges if a == p[-1] and b not in p]
        return sorted(out)

    assert sorted(r.path for r in S.simple_paths(g, 3).collect()) == walks(3)
    assert sorted(r.path for r in S.simple_paths(g, 2, spark.createDataFrame([(3,)], "id long")).collect()) == [p for p in walks(2) if p[0] == 3]
    for length in (2, 3, 4):
        want = sorted(p for p in walks(length - 1) if (p[-1], p[0]) in edges and min(p) == p[0])
        assert sorted(r.cycle for r in S.cycles(g, length).collect()) == want and (want or length == 5)
    assert [r.cycle for r in S.cycles(g, 1).collect()] == [[5]]
    assert sorted((r.path, r.hops) for r in S.all_paths(g, 1, 4, 3).collect()) == [([1, 2, 3, 4], 3), ([1, 3, 4], 2)]
    assert [r.path for r in S.all_paths(g, 1, 1, 3).collect()] == [[1]]
    assert {r.id: r.arms for r in S.stars(g, 3).collect()} == {1: 3, 3: 3}
    assert {r.component: r.members for r in S.communities(g, 2).collect()} == {1: 4, 6: 2}


def test_long_path_by_doubling(spark):
    g = plain(spark, [(k, k + 1) for k in range(21)])
    found = A.shortest_distances(g, 0)
    for end in (1, 2, 7, 8, 21):
        assert A.path_to(found, 0, end) == list(range(end + 1))
    assert A.path_to(found, 0, 99) is None


def test_paths_equal_but_for_rounding_take_the_least_predecessor(spark):
    rows = [(1, 2, "a", 0.1), (2, 4, "a", 0.2), (1, 3, "a", 0.15), (3, 4, "a", 0.15)]  # 0.1 + 0.2 > 0.15 + 0.15 in doubles
    g = graph(spark, [(i,) for i in range(1, 5)], "id long", rows, "src long, dst long, label string, weight double")
    assert {r.id: r.via for r in A.shortest_distances(g, 1).collect()} == {1: None, 2: 1, 3: 1, 4: 2}


@pytest.mark.parametrize("most", [8_000_000, 0])
def test_sweeps_and_joins_agree_with_a_loop(spark, monkeypatch, most):
    rng = random.Random(11)
    edges = sorted({(rng.randrange(150), rng.randrange(150)) for _ in range(260)})
    g = plain(spark, edges, extra=[-7, 999])
    monkeypatch.setattr("graphloom.operators.sweeps.MOST_EDGES", most)
    near = collections.defaultdict(list)
    for a, b in edges:
        near[a].append(b)
    want, between = {}, collections.Counter()
    for s in sorted({x for e in edges for x in e} | {-7, 999}):
        hops, paths, todo = {s: 0}, collections.Counter({s: 1}), [s]
        for v in todo:
            for w in near[v]:
                if w not in hops:
                    hops[w] = hops[v] + 1
                    todo.append(w)
                if hops[w] == hops[v] + 1:
                    paths[w] += paths[v]
        want[s] = (len(hops) - 1) / sum(hops.values()) if sum(hops.values()) else 0.0
        share = collections.Counter()
        for w in reversed(todo):
            for v in hops:
                if w in near[v] and hops[w] == hops[v] + 1:
                    share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                between[w] += share[w]
    assert {r.id: r.closeness for r in A.closeness(g).collect()} == pytest.approx(want)
    got = {r.id: r.betweenness for r in A.betweenness(g).collect()}
    assert got == pytest.approx({v: between[v] for v in want})
    few = spark.createDataFrame([(edges[0][0],), (999,), (5000,)], "id long")
    assert {r.id for r in A.closeness(g, few).collect()} == {edges[0][0], 999, 5000}


def test_centralities_of_many_pairs_take_no_join_of_them(spark):
    g = plain(spark, sorted({(a, (a * 7 + k) % 400) for a in range(400) for k in range(5)}))
    for found in (A.closeness(g), A.betweenness(g)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan


def test_betweenness_takes_no_sweep_for_each_vertex_of_a_way(spark):
    n, began = 6000, time.monotonic()
    way = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit("link").alias("label"))
    got = {r.id: r.betweenness for r in A.betweenness(PropertyGraph.of(spark.range(n), way)).collect()}
    assert got == {k: k * (n - 1 - k) for k in range(n)}
    assert time.monotonic() - began < 60  # a sweep from each vertex takes minutes


def _shares(edges, sources):
    """Brandes' recursion, a source after another."""
    near, between = collections.defaultdict(set), collections.Counter()
    for a, b in edges:
        near[a].add(b)
    for s in sources:
        hops, paths, todo, share = {s: 0}, collections.Counter({s: 1}), [s], collections.Counter()
        for v in todo:
            for w in near[v]:
                if w not in hops:
                    hops[w] = hops[v] + 1
                    todo.append(w)
                if hops[w] == hops[v] + 1:
                    paths[w] += paths[v]
        for v in reversed(todo):
            share[v] = sum(paths[v] / paths[w] * (1 + share[w]) for w in near[v] if hops[w] == hops[v] + 1)
            between[v] += share[v] if v != s else 0
    return between


@pytest.mark.parametrize("seed", range(3))
def test_betweenness_of_ways_and_rings_agrees_with_a_loop(spark, seed):
    rng = random.Random(seed)
    edges = {(k, k + 1) for k in range(0, 40) if k % 9} | {(27, 20), (100, 101), (101, 102), (102, 100), (103, 101), (104, 103), (110, 111), (111, 110)}
    edges |= {(rng.choice((9, 18, 27, 36)), rng.randrange(41)) for _ in range(14)} | {(200 + k, rng.randrange(205)) for k in range(5)}
    edges = sorted(e for e in edges if e[0] != e[1])
    ids_ = sorted({x for e in edges for x in e})
    for few in (ids_, rng.sample(ids_, 12)):
        got = A.betweenness(plain(spark, edges), spark.createDataFrame([(i,) for i in few], "id long"))
        want = _shares(edges, few)
        assert {r.id: r.betweenness for r in got.collect()} == pytest.approx({i: want[i] for i in ids_})


def test_reachability_does_not_broadcast_its_salted_members(spark):
    found = A.reachability(plain(spark, [(1, 2), (2, 1), (2, 3)]))
    assert {tuple(r) for r in found.collect()} == {(u, v) for u in (1, 2) for v in (1, 2, 3)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    last = [line for line in plan.splitlines() if "salt" in line and "Join" in line]
    assert last and not any("Broadcast" in line for line in last)


@pytest.mark.parametrize("most", [8_000_000, 20, 0])
def test_strong_components_by_search_and_by_rounds(spark, monkeypatch, most):
    rng = random.Random(8)
    edges = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(60)} | {(50, 51), (51, 52), (52, 50), (52, 53), (60, 60)})
    monkeypatch.setattr("graphloom.operators.sweeps.MOST_EDGES", most)
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
    reach = {}
    for s in sorted({x for e in edges for x in e} | {99}):
        todo = [s]
        for v in todo:
            todo += [w for w in near[v] if w not in todo]
        reach[s] = set(todo)
    want = {s: min(t for t in reach[s] if s in reach[t]) for s in reach}
    assert {r.id: r.component for r in A.strongly_connected(plain(spark, edges, extra=[99])).collect()} == want


def test_a_long_ring_takes_no_round_for_each_step(spark):
    n, began = 300, time.monotonic()
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"), F.lit("link").alias("label"))
    found = A.reachability(PropertyGraph.of(spark.range(n), ring))
    assert found.count() == n * n and found.distinct().count() == n * n
    assert time.monotonic() - began < 60
