"""SQL over the graph's tables: an allow-list check, then Spark's own parser and planner."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from graphloom.functions.predicates import QueryError
from graphloom.model import PropertyGraph

#: Fixed names under which the tables may be read.
RELATIONS = {"vertices", "vertex", "edges", "edge", "graph"}
_TOKEN = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]+`|[A-Za-z_][\w$]*|\d+(?:\.\d+)?|[(),;.]|\S", re.S)
_ENDS = {"where", "group", "having", "order", "window", "union", "intersect", "except", "on", "using", "select", "qualify", "cluster", "distribute", "sort", "lateral", "limit", "offset"}


def _tokens(sql: str) -> list[str]:
    return [t for t in _TOKEN.findall(sql) if not t.startswith(("--", "/*"))]


def relations(sql: str) -> list[str]:
    """Names read in FROM and JOIN clauses, subqueries and joined tables included, in order and lower case."""
    tokens, found, named = _tokens(sql), [], set()
    for k, token in enumerate(tokens):
        if token.lower() == "as" and k and k + 1 < len(tokens) and tokens[k + 1] == "(" and re.match(r"[A-Za-z_`]", tokens[k - 1]):
            named.add(tokens[k - 1].strip('`"').lower())  # WITH name AS (
    depth, open_from = 0, []
    for k, token in enumerate(tokens):
        low = token.lower()
        if token == "(":
            depth += 1
        elif token == ")":
            depth -= 1
            open_from = [d for d in open_from if d <= depth]
        elif low in ("from", "join") and not _in_function(tokens, k):
            if low == "from":
                open_from.append(depth)
            _relation(tokens, k + 1, found)
        elif token == "," and open_from and open_from[-1] == depth:
            _relation(tokens, k + 1, found)
        elif low in _ENDS and open_from and open_from[-1] == depth:
            open_from.pop()
    return [name for name in dict.fromkeys(found) if name not in named]


def _in_function(tokens: list[str], k: int) -> bool:
    """FROM within extract(... from ...), substring, trim or IS DISTINCT FROM."""
    if k and tokens[k - 1].lower() == "distinct" and k > 1 and tokens[k - 2].lower() in ("is", "not"):
        return True
    depth = 0
    for j in range(k - 1, -1, -1):
        if tokens[j] == ")":
            depth += 1
        elif tokens[j] == "(":
            if depth == 0:
                return j > 0 and tokens[j - 1].lower() in ("extract", "substring", "trim", "overlay", "substr")
            depth -= 1
        elif tokens[j].lower() == "select" and depth == 0:
            return False
    return False


def _relation(tokens: list[str], k: int, found: list[str]) -> None:
    if k < len(tokens) and re.match(r"[A-Za-z_`\"]", tokens[k]) and tokens[k].lower() not in ("lateral", "select", "values"):
        name = tokens[k].strip('`"').lower()
        while k + 2 < len(tokens) and tokens[k + 1] == ".":
            k += 2
            name += "." + tokens[k].strip('`"').lower()
        found.append(name)


def validate(sql: str) -> str:
    """The SELECT of one statement that may define a view; else a :class:`QueryError`.

    A statement is a SELECT, with or without WITH, or CREATE VIEW ... AS one.
    It reads graph tables only and has neither LIMIT, OFFSET nor DISTINCT.
    """
    tokens = _tokens(sql)
    while tokens and tokens[-1] == ";":
        tokens.pop()
    if not tokens:
        raise QueryError("no statement")
    if ";" in tokens:
        raise QueryError("more than one statement")
    low = [t.lower() for t in tokens]
    body = sql.strip().rstrip(";").strip()
    if low[0] == "create":
        head = re.match(r"create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?view\s+[\w.`\"]+\s+as\s+", body, re.I)
        if not head:
            raise QueryError("only CREATE VIEW name AS SELECT is understood")
        body = body[head.end() :]
        low = [t.lower() for t in _tokens(body)]
    if not low or low[0] not in ("select", "with"):
        raise QueryError("a view must be a SELECT")
    for word in ("limit", "offset"):
        if word in low:
            raise QueryError(f"a view can't have {word.upper()}")
    if any(a == "select" and b == "distinct" for a, b in zip(low, low[1:])):
        raise QueryError("a view can't have DISTINCT")
    found = relations(body)
    if not found:
        raise QueryError("a view must read the graph's tables")
    strange = [name for name in found if name not in RELATIONS]
    if strange:
        raise QueryError(f"not a graph table: {', '.join(strange)}")
    return body


def run(graph: PropertyGraph, sql: str) -> DataFrame:
    """A validated statement's rows; the tables are registered first, ``graph`` being the edges."""
    body = validate(sql)
    graph.as_views()
    graph.edges.createOrReplaceTempView("graph")
    return graph.vertices.sparkSession.sql(body)
