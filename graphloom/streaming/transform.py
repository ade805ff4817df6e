"""Stages that filter, change and enrich event rows, on batches and streams alike."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Stage = Callable[[DataFrame], DataFrame]

# Address prefixes and their country, region, city, latitude and longitude; and those of all other addresses.
PLACES = (
    ("192.168.", ("Local", "Internal", "Office", 37.7749, -122.4194)),
    ("10.", ("Local", "Private", "Datacenter", 40.7128, -74.0060)),
)
ELSEWHERE = ("Unknown", "Unknown", "Unknown", 0.0, 0.0)
PLACE_FIELDS = ("geo_country", "geo_region", "geo_city", "geo_latitude", "geo_longitude")


@dataclass(frozen=True)
class Rule:
    """``field operator value``; ``action`` is keep, drop or modify (with ``set_field`` and ``set_value``)."""

    field: str
    operator: str
    value: Any = None
    action: str = "keep"
    set_field: str | None = None
    set_value: Any = None

    def matches(self, df: DataFrame) -> Column:
        column = self.column(df)
        tests: dict[str, Callable[[], Column]] = {
            "equals": lambda: column == F.lit(self.value),
            "not_equals": lambda: ~column.eqNullSafe(F.lit(self.value)),  # a missing field differs from every value
            "greater_than": lambda: column > F.lit(self.value),
            "less_than": lambda: column < F.lit(self.value),
            "contains": lambda: column.cast("string").contains(self.value),
            "not_contains": lambda: ~column.cast("string").contains(self.value),
            "in": lambda: column.isin(list(self.value)),
            "not_in": lambda: ~column.isin(list(self.value)),
            "exists": lambda: column.isNotNull(),
            "not_exists": lambda: column.isNull(),
        }
        if self.operator not in tests:
            raise ValueError(f"unknown operator {self.operator}")
        return F.coalesce(tests[self.operator](), F.lit(False))

    def column(self, df: DataFrame) -> Column:
        """A column, else a key of ``metadata``, else null."""
        if self.field in df.columns:
            return F.col(f"`{self.field}`")
        if "metadata" in df.columns:
            return F.try_element_at(F.col("metadata"), F.lit(self.field))
        return F.lit(None).cast("string")


def apply_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows that no rule drops and every keep rule keeps; modify rules set their field where they match."""
    for rule in rules:
        hit = rule.matches(df)
        if rule.action == "keep":
            df = df.where(hit)
        elif rule.action == "drop":
            df = df.where(~hit)
        elif rule.action == "modify":
            df = _modified(df, rule, hit)
        else:
            raise ValueError(f"unknown action {rule.action}")
    return df


def _modified(df: DataFrame, rule: Rule, hit: Column) -> DataFrame:
    if rule.set_field in df.columns:
        return df.withColumn(rule.set_field, F.when(hit, F.lit(rule.set_value)).otherwise(F.col(rule.set_field)))
    if "metadata" in df.columns:
        added = F.map_concat(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: k != rule.set_field), F.create_map(F.lit(rule.set_field), F.lit(str(rule.set_value))))
        return df.withColumn("metadata", F.when(hit, added).otherwise(F.col("metadata")))
    return df.withColumn(rule.set_field, F.when(hit, F.lit(rule.set_value)))


def pipeline(*stages: Stage) -> Stage:
    """Stages in order, as one."""
    return lambda df: reduce(lambda d, stage: stage(d), stages, df)


def rules_stage(*rules: Rule) -> Stage:
    return lambda df: apply_rules(df, list(rules))


def latency_stage(ts: str = "ts", now: Column | None = None) -> Stage:
    """Adds ``processed_ms`` and ``latency_ms``; ``now`` stands for the current time."""

    def run(df: DataFrame) -> DataFrame:
        at = F.unix_millis((F.current_timestamp() if now is None else now).cast("timestamp"))
        return df.withColumn("processed_ms", at).withColumn("latency_ms", at - F.unix_millis(F.col(ts).cast("timestamp")))

    return run


def place_stage(address: str = "ip_address") -> Stage:
    """Adds the ``PLACE_FIELDS`` by the address's prefix; null where there is no address."""

    def run(df: DataFrame) -> DataFrame:
        for k, name in enumerate(PLACE_FIELDS):
            value = F.when(F.col(address).isNull(), None)
            for prefix, place in PLACES:
                value = value.when(F.col(address).startswith(prefix), place[k])
            df = df.withColumn(name, value.otherwise(ELSEWHERE[k]))
        return df

    return run


def lookup_stage(table: DataFrame, on: str) -> Stage:
    """Joins columns of a reference table; Spark broadcasts it only below its own size limit."""
    return lambda df: df.join(table, on, "left")


@dataclass(frozen=True)
class FieldMap:
    """How a target column is made: rename, convert, map, extract or custom of a source field."""

    target: str
    source: str
    operation: str = "rename"
    argument: Any = None

    def column(self) -> Column:
        source = F.col(self.source)
        if self.operation == "rename":
            return source.alias(self.target)
        if self.operation == "convert":
            return source.try_cast(self.argument).alias(self.target)
        if self.operation == "map":
            pairs = [F.lit(x) for pair in self.argument.items() for x in pair]
            return F.try_element_at(F.create_map(*pairs), source).alias(self.target)
        if self.operation == "extract":
            found = F.regexp_extract(source, self.argument, 1)
            return F.when(found != "", found).alias(self.target)
        if self.operation == "custom":
            return self.argument(source).alias(self.target)
        raise ValueError(f"unknown operation {self.operation}")


@dataclass(frozen=True)
class Extraction:
    """Rows of one change kind out of events: ``op`` with its key fields and properties, where ``rules`` hold."""

    op: str
    keys: tuple[FieldMap, ...]
    properties: tuple[FieldMap, ...] = ()
    rules: tuple[Rule, ...] = ()


def extract_changes(df: DataFrame, extractions: list[Extraction], seq: str = "seq") -> DataFrame:
    """A change table (see ``sources.changelog``) out of events, one part for each extraction."""
    out = None
    for e in extractions:
        found = apply_rules(df, list(e.rules))
        keys = {m.target: m.column() for m in e.keys}
        pairs = [x for m in e.properties for x in (F.lit(m.target), m.column().cast("string"))]
        after = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.lit(None).cast("map<string,string>")
        none = lambda c, kind: keys[c].cast(kind).alias(c) if c in keys else F.lit(None).cast(kind).alias(c)
        source = F.col("source") if "source" in found.columns else F.lit(None)
        part = found.select(
            F.col(seq).cast("long").alias("seq"), F.lit(None).cast("string").alias("changeset_id"), source.cast("string").alias("source"), F.lit(e.op).alias("op"),
            none("id", "long"), none("src", "long"), none("dst", "long"), none("label", "string"), F.lit(None).cast("map<string,string>").alias("before"), after.alias("after"),
        )
        out = part if out is None else out.unionByName(part)
    return out
