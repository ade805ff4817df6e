"""Comparisons of the pattern language as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = ("=", "!=", "<", "<=", ">", ">=")
NUMBERS = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.DecimalType)


class QueryError(ValueError):
    """A statement that can't be parsed or has no meaning for the graph's columns."""


def kind(data_type: T.DataType) -> str:
    """The comparison class of a column's type."""
    if isinstance(data_type, NUMBERS):
        return "number"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return "null" if isinstance(data_type, T.NullType) else "other"


def compare(op: str, left: Column, left_type: T.DataType, right: Column, right_type: T.DataType) -> Column:
    """``left op right``: null if a side is missing, and NaN equals and orders with nothing.

    Numbers compare by value, strings by code point.  Other classes only know
    equality, and two different classes can't be compared.
    """
    a, b = kind(left_type), kind(right_type)
    if "null" not in (a, b) and a != b and {a, b} != {"string", "time"}:
        raise QueryError(f"can't compare {left_type.simpleString()} with {right_type.simpleString()}")
    if a in ("boolean", "other") and op not in ("=", "!="):
        raise QueryError(f"{left_type.simpleString()} has no order")
    plain = {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}
    if op not in plain:
        raise QueryError(f"unknown comparison {op}")
    found = plain[op]
    floating = [side for side, t in ((left, left_type), (right, right_type)) if isinstance(t, (T.DoubleType, T.FloatType))]
    for side in floating:
        found = found | F.isnan(side) if op == "!=" else found & ~F.isnan(side)
    return found


def literal_type(value) -> T.DataType:
    if value is None:
        return T.NullType()
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType()
    return T.DoubleType() if isinstance(value, float) else T.StringType()


def number(text: str) -> int | float:
    """A numeric literal: an integer where its value is one."""
    value = float(text)
    return int(value) if value.is_integer() and abs(value) < 2**63 else value
