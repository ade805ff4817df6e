import pytest

from graphloom.functions.predicates import QueryError
from graphloom.functions.values import as_float, display, same_value, type_name
from graphloom.plans import gql
from graphloom.plans.matching import query
from tests.graphs import people


def names(df, column="name"):
    return sorted(r[column] for r in df.toDF(*(c.replace(".", "_") for c in df.columns)).collect())


@pytest.fixture(scope="module")
def g(spark):
    return people(spark)


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ("v.age > 25", ["Alice", "Charlie", "Diana"]),
        ("v.age > 25 AND v.department = 'Engineering'", ["Alice", "Diana"]),
        ("v.age < 26 OR v.name = \"Charlie\"", ["Bob", "Charlie"]),
        ("v.age >= 30 AND (v.name = 'Bob' OR v.name != 'Alice')", ["Charlie"]),
        ("v.active", ["Alice", "Diana"]),
        ("v.active = true", ["Alice", "Diana"]),
        ("NOT v.active", ["Bob", "Charlie"]),
        ("v.missing != 3", []),
        ("v.age <> 30 and id(v) < 3", ["Bob"]),
        ("true", ["Alice", "Bob", "Charlie", "Diana"]),
        ("false", []),
        ("v.age = 30.0", ["Alice"]),
        ("v.age > -1", ["Alice", "Bob", "Charlie", "Diana"]),
    ],
)
def test_where(g, where, want):
    assert names(query(g, f"MATCH (v:Person) WHERE {where} RETURN v.name"), "v_name") == want


@pytest.mark.parametrize(
    ("text", "column", "want"),
    [
        ("MATCH (a)-[:friend]->(b) RETURN b.name", "b_name", ["Bob", "Charlie"]),
        ("MATCH (b)<-[:friend]-(a) RETURN b.name", "b_name", ["Bob", "Charlie"]),
        ("MATCH (a {name: 'Bob'})-[]-(b) RETURN b.name", "b_name", ["Alice", "Charlie", "Diana"]),
        ("MATCH (a)-[e {since: 2021}]->(b) RETURN e.label, b.name", "b_name", ["Charlie"]),
        ("MATCH (a)-->(b)-->(c) RETURN c.name", "c_name", ["Charlie", "Diana"]),
        ("MATCH (a)-[:friend]->(b), (b)-[:colleague]->(c) RETURN c.name", "c_name", ["Diana"]),
        ("MATCH (x)-->(b), (a)-[:friend]->(x) RETURN b.name", "b_name", ["Charlie", "Diana"]),
        ("MATCH (a)-->(a) RETURN a.name", "a_name", []),
        ("MATCH (:Person {active: true})-->(b) RETURN b.name;", "b_name", ["Bob"]),
        ("MATCH (a:Nobody) RETURN a.name", "a_name", []),
    ],
)
def test_shapes(g, text, column, want):
    assert names(query(g, text), column) == want


def test_results(g):
    assert query(g, "MATCH (a)-[:friend]->(b) RETURN *").count() == 4
    assert query(g, "MATCH (a)-[:friend]->(b) RETURN a").columns == ["a.id", "a.type", "a.name", "a.age", "a.active", "a.department"]
    rows = query(g, "MATCH (a) RETURN a.department AS d, count(*) AS n, max(a.age) ORDER BY d DESC").collect()
    assert [tuple(r) for r in rows] == [("Marketing", 1, 35), ("Engineering", 3, 30)]
    assert [r[0] for r in query(g, "MATCH (a) RETURN a.name ORDER BY a.age DESC SKIP 1 LIMIT 2").collect()] == ["Alice", "Diana"]
    assert query(g, "MATCH (a) RETURN DISTINCT a.department").count() == 2


@pytest.mark.parametrize("text", ["", "MATCH (a RETURN a", "DELETE a", "MATCH (a)<-[]->(b) RETURN a", "MATCH (a) RETURN f(a)", "MATCH (a) RETURN a extra", "MATCH (a) WHERE a.x ~ 3 RETURN a", "MATCH (a) RETURN a LIMIT 1.5"])
def test_bad_text(text):
    with pytest.raises(QueryError):
        gql.parse(text)


@pytest.mark.parametrize("text", ["MATCH (a) WHERE a.age = 'x' RETURN a", "MATCH (a) WHERE a.active < true RETURN a", "MATCH (a) RETURN b.name", "CREATE (a:Person)", "MATCH (a)-[e]->(b)-[e]->(c) RETURN a"])
def test_bad_meaning(g, text):
    with pytest.raises(QueryError):
        query(g, text)


def test_escapes_and_numbers():
    found = gql.parse(r"MATCH (a {n: 'it\'s', k: -2, x: 1.5e1, t: TRUE, z: null}) RETURN a").paths[0].nodes[0]
    assert found.props == {"n": "it's", "k": -2, "x": 15, "t": True, "z": None}


def test_filters_reach_the_scan(spark, sf_dir):
    from graphloom.sources.tables import star_graph

    plan = query(star_graph(spark, sf_dir), "MATCH (c:Customer)-[:placed]->(o:Order) WHERE o.totalprice > 100000 RETURN c.name, o.totalprice")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,100000" in plan.replace(".0", "")
    assert "lineitem" not in plan and "part.parquet" not in plan


def test_values():
    assert [type_name(x) for x in (None, True, 1, 1.5, "a", [1, "b"])] == ["Null", "Bool", "Int64", "Float64", "String", "Vec"]
    assert as_float(3) == 3.0 and as_float(True) is None and as_float("3") is None
    assert same_value(1, 1.0) and not same_value(1, True) and same_value(float("nan"), float("nan")) and same_value([1, [2]], [1, [2]])
    assert display([1, "a", None, True]) == '[1, "a", null, true]'
