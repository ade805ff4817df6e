"""Event metrics and alerts on them."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import event_time

EQUAL_WITHIN = 0.001


def event_metrics(df: DataFrame, length: str = "60 seconds", ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """``window_start, window_end, event_type, events, rate`` (events a second)."""
    grouped = event_time(df, ts).groupBy(F.window(ts, length).alias("w"), kind).agg(F.count("*").alias("events"))
    seconds = F.unix_micros("w.end") - F.unix_micros("w.start")
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), kind, "events", (F.col("events") * F.lit(1e6) / seconds).alias("rate"))


@dataclass(frozen=True)
class Condition:
    """``metric`` is events or rate, of one event type or of all; ``operator`` one of > >= < <= = !=."""

    metric: str
    operator: str
    threshold: float
    event_type: str | None = None

    def column(self) -> Column:
        value, bound = F.col(self.metric).cast("double"), F.lit(float(self.threshold))
        near = F.abs(value - bound) < EQUAL_WITHIN
        tests = {">": value > bound, ">=": value >= bound, "<": value < bound, "<=": value <= bound, "=": near, "!=": ~near}
        test = tests[self.operator]
        return test if self.event_type is None else test & (F.col("event_type") == self.event_type)


@dataclass(frozen=True)
class AlertRule:
    name: str
    conditions: tuple[Condition, ...]
    cooldown: float = 0.0  # seconds


def alerts(metrics: DataFrame, rules: list[AlertRule]) -> DataFrame:
    """``rule, window_start, window_end, event_type, events, rate`` where any of a rule's conditions holds."""
    parts = []
    for rule in rules:
        fired = reduce(lambda a, b: a | b, (c.column() for c in rule.conditions))
        parts.append(metrics.where(fired).select(F.lit(rule.name).alias("rule"), "window_start", "window_end", "event_type", "events", "rate"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def after_cooldown(fired: DataFrame, rules: list[AlertRule]) -> DataFrame:
    """Alerts that begin at least the rule's cooldown after the one kept before them.

    A rule's windows are folded in order on the executors; one row a window
    and type, so a rule's history is short.
    """
    import pandas as pd

    waits = {r.name: r.cooldown for r in rules}

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["window_start", "event_type"])
        wait, last, kept = waits[rows["rule"].iloc[0]], None, []
        for at in rows["window_start"]:
            fits = last is None or (at - last).total_seconds() >= wait
            kept.append(fits)
            last = at if fits else last
        return rows[kept]

    return fired.groupBy("rule").applyInPandas(keep, fired.schema)


@dataclass
class AlertBook:
    """Open and resolved alerts, fed from ``foreachBatch``; actions get each new alert once."""

    rules: list[AlertRule]
    actions: list[Callable[[dict], None]] = field(default_factory=list)
    clock: Callable[[], float] = time.time
    most_per_batch: int = 10_000
    entries: list[dict] = field(default_factory=list)
    fired_at: dict[str, float] = field(default_factory=dict)

    def feed(self, metrics: DataFrame) -> list[dict]:
        """Alerts of one batch's metrics; more than ``most_per_batch`` rows is an error, not a cut."""
        rows = alerts(metrics, self.rules).orderBy("window_start", "rule", "event_type").limit(self.most_per_batch + 1).collect()
        if len(rows) > self.most_per_batch:
            raise OverflowError("too many alerts in a batch")
        waits, fresh = {r.name: r.cooldown for r in self.rules}, []
        for row in rows:
            now = self.clock()
            if now - self.fired_at.get(row["rule"], float("-inf")) < waits[row["rule"]]:
                continue
            self.fired_at[row["rule"]] = now
            entry = {"alert_id": len(self.entries) + 1, "status": "open", "at": now, **row.asDict()}
            self.entries.append(entry)
            fresh.append(entry)
            for action in self.actions:
                action(entry)
        return fresh

    def resolve(self, alert_id: int) -> bool:
        found = next((e for e in self.entries if e["alert_id"] == alert_id and e["status"] == "open"), None)
        if found:
            found["status"], found["resolved_at"] = "resolved", self.clock()
        return found is not None

    def open(self) -> list[dict]:
        return [e for e in self.entries if e["status"] == "open"]
