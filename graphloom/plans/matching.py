"""Statements of the pattern language as DataFrames."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.predicates import QueryError, compare, kind, literal_type
from graphloom.model import PropertyGraph, reversed_edges

from .gql import Aggregate, Compare, Create, Delete, Edge, Item, Literal, Logic, Match, Node, Path, Property, parse

MARK = "·"


class Matcher:
    """One pattern's joins: a column ``variable·property`` for every bound property."""

    def __init__(self, graph: PropertyGraph):
        self.graph = graph
        self.df: DataFrame | None = None
        self.bound: dict[str, str] = {}  # variable: vertex or edge
        self.columns = {"vertex": graph.vertices.columns, "edge": graph.edges.columns}
        self.made = 0

    def name(self, var: str | None) -> str:
        self.made += 1
        return var or f"_{self.made}"

    def column(self, var: str, prop: str) -> Column:
        return F.col(f"`{var}{MARK}{prop}`")

    def type_of(self, var: str, prop: str) -> T.DataType:
        table = self.graph.vertices if self.bound[var] == "vertex" else self.graph.edges
        return table.schema[prop].dataType

    def prefixed(self, df: DataFrame, var: str) -> DataFrame:
        return df.select(*(F.col(f"`{c}`").alias(f"{var}{MARK}{c}") for c in df.columns))

    def narrowed(self, df: DataFrame, label_column: str, label: str | None, props: dict[str, Any]) -> DataFrame:
        """Label and inline properties as filters below the joins; a property no row has matches nothing."""
        if label is not None:
            df = df.where(F.col(label_column) == label)
        for key, value in props.items():
            if key not in df.columns:
                return df.where(F.lit(False))
            if value is None:
                df = df.where(F.col(f"`{key}`").isNull())
            elif kind(df.schema[key].dataType) != kind(literal_type(value)):
                return df.where(F.lit(False))
            else:
                df = df.where(compare("=", F.col(f"`{key}`"), df.schema[key].dataType, F.lit(value), literal_type(value)))
        return df

    def node(self, node: Node) -> tuple[str, DataFrame]:
        var = self.name(node.var)
        return var, self.prefixed(self.narrowed(self.graph.vertices, "type", node.label, node.props), var)

    def start(self, node: Node) -> str:
        if node.var in self.bound:
            return self.rebind(node)
        var, rows = self.node(node)
        self.df = rows if self.df is None else self.df.crossJoin(rows)
        self.bound[var] = "vertex"
        return var

    def rebind(self, node: Node) -> str:
        """A variable used again is the same vertex; new conditions are added."""
        if self.bound[node.var] != "vertex":
            raise QueryError(f"{node.var} is an edge")
        if node.label is not None:
            self.df = self.df.where(self.column(node.var, "type") == node.label)
        for key, value in node.props.items():
            self.df = self.df.where(self.predicate(Compare("=", Property(node.var, key), Literal(value))))
        return node.var

    def expand(self, at: str, edge: Edge, node: Node) -> str:
        var = self.name(edge.var)
        if var in self.bound:
            raise QueryError(f"edge variable {var} is used twice")
        edges = self.narrowed(self.graph.edges, "label", edge.label, edge.props)
        if edge.direction == "in":
            edges = reversed_edges(edges)
        elif edge.direction == "both":
            edges = edges.unionByName(reversed_edges(edges))
        own = self.prefixed(edges, var)
        self.df = self.df.join(own, self.column(at, "id") == self.column(var, "src"))
        self.bound[var] = "edge"
        if node.var in self.bound:
            self.df = self.df.where(self.column(node.var, "id") == self.column(var, "dst"))
            return self.rebind(node)
        to, rows = self.node(node)
        self.df = self.df.join(rows, self.column(var, "dst") == self.column(to, "id"))
        self.bound[to] = "vertex"
        return to

    def paths(self, paths: list[Path]) -> Matcher:
        # a path that shares a variable with what is bound joins it; others would be a product
        waiting = list(paths)
        while waiting:
            path = next((p for p in waiting if any(n.var in self.bound for n in p.nodes)), waiting[0])
            waiting.remove(path)
            first = next((k for k, n in enumerate(path.nodes) if n.var in self.bound), 0)
            start = at = self.start(path.nodes[first])
            for edge, node in zip(path.edges[first:], path.nodes[first + 1 :]):
                at = self.expand(at, edge, node)
            at = start
            turned = {"out": "in", "in": "out", "both": "both"}
            for k in range(first - 1, -1, -1):
                edge = path.edges[k]
                at = self.expand(at, Edge(turned[edge.direction], edge.var, edge.label, edge.props), path.nodes[k])
        return self

    # expressions

    def value(self, part: Any) -> tuple[Column, T.DataType]:
        if isinstance(part, Literal):
            return F.lit(part.value), literal_type(part.value)
        if isinstance(part, Property):
            if part.var not in self.bound:
                raise QueryError(f"unknown variable {part.var}")
            prop = part.name or ("id" if self.bound[part.var] == "vertex" else "label")
            if prop not in self.columns[self.bound[part.var]]:
                return F.lit(None), T.NullType()
            return self.column(part.var, prop), self.type_of(part.var, prop)
        raise QueryError(f"not a value: {part}")

    def predicate(self, part: Any) -> Column:
        if isinstance(part, Logic):
            parts = [self.predicate(p) for p in part.parts]
            if part.op == "not":
                return ~parts[0]
            return reduce((lambda a, b: a & b) if part.op == "and" else (lambda a, b: a | b), parts)
        if isinstance(part, Compare):
            left, right = self.value(part.left), self.value(part.right)
            if "null" in (kind(left[1]), kind(right[1])):
                return F.lit(None).cast("boolean")  # a missing side compares with nothing
            return compare(part.op, *left, *right)
        column, data_type = self.value(part)
        if kind(data_type) == "boolean":
            return F.coalesce(column, F.lit(False))
        return F.lit(False)

    def where(self, part: Any) -> Matcher:
        if part is not None:
            self.df = self.df.where(self.predicate(part))
        return self

    # results

    def item(self, item: Item) -> list[tuple[str, Column]]:
        value = item.value
        if isinstance(value, Property) and value.name is None and item.alias is None:
            if value.var not in self.bound:
                raise QueryError(f"unknown variable {value.var}")
            return [(f"{value.var}.{c}", self.column(value.var, c)) for c in self.columns[self.bound[value.var]]]
        if isinstance(value, Property):
            return [(item.alias or f"{value.var}.{value.name}", self.value(value)[0])]
        if isinstance(value, Literal):
            return [(item.alias or str(value.value), F.lit(value.value))]
        raise QueryError(f"can't return {value}")

    def aggregate(self, value: Aggregate) -> Column:
        if value.of is None:
            return F.count("*")
        column = self.value(value.of)[0]
        functions = {"count": F.countDistinct if value.distinct else F.count, "sum": F.sum_distinct if value.distinct else F.sum, "avg": F.avg, "min": F.min, "max": F.max, "collect": F.collect_set if value.distinct else F.collect_list}
        return functions[value.function](column)

    def result(self, match: Match) -> DataFrame:
        if not match.items:
            return self.everything()
        plain = [i for i in match.items if not isinstance(i.value, Aggregate)]
        folded = [i for i in match.items if isinstance(i.value, Aggregate)]
        named = [pair for i in plain for pair in self.item(i)]
        if folded:
            names = [i.alias or _aggregate_name(i.value) for i in folded]
            columns = [self.aggregate(i.value).alias(n) for i, n in zip(folded, names)]
            out = self.df.groupBy(*(c.alias(n) for n, c in named)).agg(*columns)
            order = [self._sorted(out, v, asc) for v, asc in match.order]
        else:
            order = [self.value(v)[0].asc() if asc else self.value(v)[0].desc() for v, asc in match.order if isinstance(v, Property) and v.var in self.bound]
            if len(order) != len(match.order):
                raise QueryError("ORDER BY needs properties of bound variables")
            if match.distinct:
                order = [self._sorted(None, v, asc) for v, asc in match.order]
            picked = [c.alias(n) for n, c in named]
            out = self.df.select(*picked).distinct() if match.distinct else (self.df.orderBy(*order) if order else self.df).select(*picked)
            order = order if match.distinct else []
        if order:
            out = out.orderBy(*order)
        if match.skip:
            out = out.offset(match.skip)
        return out if match.limit is None else out.limit(match.limit)

    def _sorted(self, out: DataFrame | None, value: Any, ascending: bool) -> Column:
        if isinstance(value, Property):
            name = value.var if value.name is None else f"{value.var}.{value.name}"
        else:
            name = _aggregate_name(value)
        column = F.col(f"`{name}`")
        return column.asc() if ascending else column.desc()

    def everything(self) -> DataFrame:
        """Every bound vertex of every match, repeats kept."""
        own = [v for v, k in self.bound.items() if k == "vertex"]
        structs = [F.struct(*(self.column(v, c).alias(c) for c in self.columns["vertex"])) for v in own]
        return self.df.select(F.explode(F.array(*structs)).alias("v")).select("v.*")


def _aggregate_name(value: Aggregate) -> str:
    inner = "*" if value.of is None else value.of.var if value.of.name is None else f"{value.of.var}.{value.of.name}"
    return f"{value.function}({'distinct ' if value.distinct else ''}{inner})"


def run_match(graph: PropertyGraph, match: Match) -> DataFrame:
    return Matcher(graph).paths(match.paths).where(match.where).result(match)


def matched_ids(graph: PropertyGraph, delete: Delete) -> DataFrame:
    """The distinct ids that a DELETE names."""
    found = Matcher(graph).paths(delete.paths).where(delete.where)
    for name in delete.names:
        if found.bound.get(name) != "vertex":
            raise QueryError(f"{name} is not a matched vertex")
    ids = F.array(*(found.column(n, "id") for n in delete.names))
    return found.df.select(F.explode(ids).alias("id")).distinct()


def created_rows(graph: PropertyGraph, create: Create) -> tuple[list[dict], list[dict]]:
    """Rows of the vertices and edges that a CREATE makes: ids follow the largest in the graph."""
    last = graph.vertices.agg(F.max("id")).first()[0]
    following = 1 if last is None else last + 1
    known: dict[str, int] = {}
    vertices, edges = [], []

    def made(node: Node) -> int:
        nonlocal following
        if node.var is not None and node.var in known:
            return known[node.var]
        own = following
        following += 1
        if node.var is not None:
            known[node.var] = own
        vertices.append({"id": own, "type": node.label, **node.props})
        return own

    for path in create.paths:
        ids = [made(n) for n in path.nodes]
        for k, edge in enumerate(path.edges):
            ends = (ids[k + 1], ids[k]) if edge.direction == "in" else (ids[k], ids[k + 1])
            edges.append({"src": ends[0], "dst": ends[1], "label": edge.label or "related", **edge.props})
    return vertices, edges


def query(graph: PropertyGraph, text: str) -> DataFrame:
    """The rows of a MATCH ... RETURN statement; other statements go to a store."""
    statement = parse(text)
    if not isinstance(statement, Match):
        raise QueryError("only MATCH ... RETURN reads; use a store to change the graph")
    return run_match(graph, statement)
