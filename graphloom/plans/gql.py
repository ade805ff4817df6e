"""Text of the pattern language to a syntax tree."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from graphloom.functions.predicates import QueryError, number


@dataclass(frozen=True)
class Node:
    var: str | None = None
    label: str | None = None
    props: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Edge:
    direction: str = "out"  # out, in, both
    var: str | None = None
    label: str | None = None
    props: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Path:
    nodes: list[Node]
    edges: list[Edge]


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Property:
    var: str
    name: str | None  # None: the variable itself


@dataclass(frozen=True)
class Compare:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Logic:
    op: str  # and, or, not
    parts: list[Any]


@dataclass(frozen=True)
class Aggregate:
    function: str
    of: Any  # None: rows
    distinct: bool = False


@dataclass(frozen=True)
class Item:
    value: Any
    alias: str | None = None


@dataclass(frozen=True)
class Match:
    paths: list[Path]
    where: Any = None
    items: list[Item] = field(default_factory=list)  # none: everything
    distinct: bool = False
    order: list[tuple[Any, bool]] = field(default_factory=list)  # value, ascending
    skip: int | None = None
    limit: int | None = None


@dataclass(frozen=True)
class Create:
    paths: list[Path]


@dataclass(frozen=True)
class Delete:
    paths: list[Path]
    where: Any
    names: list[str]


_LEX = re.compile(
    r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<mark><=|>=|!=|<>|->|<-|[-()\[\]{}:,.=<>*;]))""",
    re.S,
)
AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text.rstrip()):
            found = _LEX.match(text, at)
            if not found:
                raise QueryError(f"unexpected character at {at}: {text[at : at + 10]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        at = self.at + ahead
        return self.tokens[at] if at < len(self.tokens) else ("end", "")

    def mark(self, *wanted: str) -> str | None:
        if self.peek()[0] == "mark" and self.peek()[1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def word(self, *wanted: str) -> str | None:
        if self.peek()[0] == "name" and self.peek()[1].lower() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1].lower()
        return None

    def need(self, found, what: str):
        if found is None:
            raise QueryError(f"expected {what}, found {self.peek()[1] or 'the end'!r}")
        return found

    def name(self) -> str:
        kind, text = self.peek()
        self.need(text if kind == "name" else None, "a name")
        self.at += 1
        return text

    def statement(self) -> Match | Create | Delete:
        if self.word("create"):
            found = Create(self.paths())
        elif self.word("match"):
            found = self.matched()
        elif self.word("delete"):
            raise QueryError("DELETE needs a MATCH")
        else:
            found = self.need(None, "MATCH, CREATE or DELETE")
        self.mark(";")
        if self.peek()[0] != "end":
            self.need(None, "the end")
        return found

    def matched(self) -> Match | Delete:
        paths = self.paths()
        where = self.either() if self.word("where") else None
        if self.word("delete"):
            names = [self.name()]
            while self.mark(","):
                names.append(self.name())
            return Delete(paths, where, names)
        self.need(self.word("return"), "RETURN or DELETE")
        distinct = bool(self.word("distinct"))
        items: list[Item] = []
        if not self.mark("*") and self.peek()[0] != "end":
            items.append(self.item())
            while self.mark(","):
                items.append(self.item())
        order = []
        if self.word("order"):
            self.need(self.word("by"), "BY")
            order.append(self.ordered())
            while self.mark(","):
                order.append(self.ordered())
        skip = self.whole() if self.word("skip", "offset") else None
        limit = self.whole() if self.word("limit") else None
        return Match(paths, where, items, distinct, order, skip, limit)

    def whole(self) -> int:
        value = self.need(self.literal(), "a whole number").value
        if not isinstance(value, int) or isinstance(value, bool):
            raise QueryError(f"not a whole number: {value!r}")
        return value

    def ordered(self) -> tuple[Any, bool]:
        value = self.operand()
        return value, self.word("desc", "descending", "asc", "ascending") not in ("desc", "descending")

    def item(self) -> Item:
        value = self.operand()
        return Item(value, self.name() if self.word("as") else None)

    def paths(self) -> list[Path]:
        found = [self.path()]
        while self.mark(","):
            found.append(self.path())
        return found

    def path(self) -> Path:
        nodes, edges = [self.node()], []
        while self.peek() in (("mark", "-"), ("mark", "<-")):
            edges.append(self.edge())
            nodes.append(self.node())
        return Path(nodes, edges)

    def inside(self) -> tuple[str | None, str | None, dict[str, Any]]:
        var = self.name() if self.peek()[0] == "name" else None
        label = self.name() if self.mark(":") else None
        return var, label, self.properties()

    def node(self) -> Node:
        self.need(self.mark("("), "(")
        found = Node(*self.inside())
        self.need(self.mark(")"), ")")
        return found

    def edge(self) -> Edge:
        back = self.need(self.mark("-", "<-"), "an edge") == "<-"
        var, label, props = None, None, {}
        if self.mark("["):
            var, label, props = self.inside()
            self.need(self.mark("]"), "]")
        forward = self.need(self.mark("->", "-"), "-> or -") == "->"
        if back and forward:
            raise QueryError("an edge can't point both ways")
        return Edge("in" if back else "out" if forward else "both", var, label, props)

    def properties(self) -> dict[str, Any]:
        found: dict[str, Any] = {}
        if not self.mark("{"):
            return found
        while not self.mark("}"):
            if found:
                self.need(self.mark(","), ",")
            key = self.name()
            self.need(self.mark(":"), ":")
            found[key] = self.need(self.literal(), "a literal").value
        return found

    def either(self) -> Any:
        parts = [self.both()]
        while self.word("or"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Logic("or", parts)

    def both(self) -> Any:
        parts = [self.negated()]
        while self.word("and"):
            parts.append(self.negated())
        return parts[0] if len(parts) == 1 else Logic("and", parts)

    def negated(self) -> Any:
        if self.word("not"):
            return Logic("not", [self.negated()])
        if self.mark("("):
            found = self.either()
            self.need(self.mark(")"), ")")
            return found
        left = self.operand()
        op = self.mark("=", "!=", "<>", "<", "<=", ">", ">=")
        return Compare("!=" if op == "<>" else op, left, self.operand()) if op else left

    def literal(self) -> Literal | None:
        kind, text = self.peek()
        minus = kind == "mark" and text == "-" and self.peek(1)[0] == "number"
        if minus:
            self.at += 1
            kind, text = self.peek()
        if kind == "number":
            self.at += 1
            return Literal(number(("-" if minus else "") + text))
        if kind == "string":
            self.at += 1
            return Literal(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "name" and text.lower() in ("true", "false", "null") and self.peek(1) != ("mark", "."):
            self.at += 1
            return Literal({"true": True, "false": False, "null": None}[text.lower()])
        return None

    def operand(self) -> Any:
        found = self.literal()
        if found:
            return found
        name = self.name()
        if self.mark("("):
            function = name.lower()
            if function == "id":
                value: Any = Property(self.name(), "id")
            elif function in AGGREGATES:
                distinct = bool(self.word("distinct"))
                value = Aggregate(function, None if self.mark("*") else self.operand(), distinct)
            else:
                raise QueryError(f"unknown function {name}")
            self.need(self.mark(")"), ")")
            return value
        return Property(name, self.name() if self.mark(".") else None)


def parse(text: str) -> Match | Create | Delete:
    """One statement: MATCH ... RETURN, MATCH ... DELETE or CREATE."""
    return _Parser(text).statement()
