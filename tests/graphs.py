"""Small graphs that several test files share."""

from graphloom.model import PropertyGraph


def graph(spark, vertices, vertex_schema, edges, edge_schema="src long, dst long, label string"):
    return PropertyGraph.of(spark.createDataFrame(vertices, vertex_schema), spark.createDataFrame(edges, edge_schema))


def people(spark):
    rows = [(1, "Person", "Alice", 30, True, "Engineering"), (2, "Person", "Bob", 25, False, "Engineering"), (3, "Person", "Charlie", 35, None, "Marketing"), (4, "Person", "Diana", 28, True, "Engineering")]
    return graph(spark, rows, "id long, type string, name string, age long, active boolean, department string", [(1, 2, "friend", 2020), (2, 3, "friend", 2021), (2, 4, "colleague", None)], "src long, dst long, label string, since long")


def plain(spark, edges, extra=()):
    ids = sorted({i for e in edges for i in e[:2]} | set(extra))
    rows = [(*e, "link")[:3] if len(e) == 2 else e for e in edges]
    return graph(spark, [(i,) for i in ids], "id long", rows)


WEB = [(1, 2), (1, 3), (1, 4), (1, 5), (3, 1), (3, 4), (5, 6), (5, 7), (5, 1), (6, 5), (7, 5), (2, 4)]
