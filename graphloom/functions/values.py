"""Property values: type names, accessors and display."""

from __future__ import annotations

import math
from typing import Any


def type_name(value: Any) -> str:
    if value is None:
        return "Null"
    if isinstance(value, bool):
        return "Bool"
    if isinstance(value, int):
        return "Int64"
    if isinstance(value, float):
        return "Float64"
    if isinstance(value, str):
        return "String"
    if isinstance(value, (list, tuple)):
        return "Vec"
    raise TypeError(f"not a property value: {value!r}")


def as_float(value: Any) -> float | None:
    """The value as a float if it is a number; integers widen, nothing else converts."""
    return float(value) if type_name(value) in ("Int64", "Float64") else None


def same_value(a: Any, b: Any) -> bool:
    """Equality by value: numbers with each other, NaN with itself, kinds apart otherwise."""
    numbers = ("Int64", "Float64")
    if type_name(a) in numbers and type_name(b) in numbers:
        return a == b or (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))
    if type_name(a) != type_name(b):
        return False
    if type_name(a) == "Vec":
        return len(a) == len(b) and all(map(same_value, a, b))
    return a == b


def display(value: Any) -> str:
    """Strings in quotes, lists in brackets, null and booleans in lower case."""
    kind = type_name(value)
    if kind == "String":
        return f'"{value}"'
    if kind == "Vec":
        return "[" + ", ".join(map(display, value)) + "]"
    return {"Null": "null", "Bool": str(value).lower()}.get(kind, str(value))
