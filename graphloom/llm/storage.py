"""Kept tables, and names that don't clash."""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphloom.sources.shared import GROUP_BYTES, discard, new_dir, saved, shared_dir

__all__ = ["GROUP_BYTES", "discard", "free_name", "new_dir", "saved", "shared_dir"]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name

