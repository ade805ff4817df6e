"""Event-time windows over batches and streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.ranked import running_rank


@dataclass(frozen=True)
class Tumbling:
    length: str


@dataclass(frozen=True)
class Sliding:
    length: str
    slide: str


@dataclass(frozen=True)
class Session:
    gap: str = "30 seconds"


@dataclass(frozen=True)
class Count:
    events: int


@dataclass(frozen=True)
class Global:
    pass


@dataclass(frozen=True)
class Measure:
    """``function`` is count, sum, average, min, max, distinct or custom."""

    function: str
    field: str | None = None
    name: str | None = None
    custom: Callable[[pd.DataFrame], float] | None = None

    def alias(self) -> str:
        return self.name or (self.function if self.field is None else f"{self.function}_{self.field}")


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """``ts`` as a timestamp that watermarks accept; times without zone are taken in the session's."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def measure(spec: Measure, streaming: bool = False) -> Column:
    """Averages are over all events; missing least, largest and sums are 0.0; distinct counts are exact."""
    column = F.col(spec.field) if spec.field else None
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    if spec.function == "count":
        found = F.count("*")
    elif spec.function == "sum":
        found = zero(F.sum(column))
    elif spec.function == "average":
        found = zero(F.sum(column)) / F.count("*")
    elif spec.function == "min":
        found = zero(F.min(column))
    elif spec.function == "max":
        found = zero(F.max(column))
    elif spec.function == "distinct":
        found = F.size(F.collect_set(column)).cast("long") if streaming else F.countDistinct(column)
    else:
        raise ValueError(f"unknown measure {spec.function}")
    return found.alias(spec.alias())


def window_column(window, ts: str = "ts") -> Column:
    if isinstance(window, Tumbling):
        return F.window(ts, window.length)
    if isinstance(window, Sliding):
        return F.window(ts, window.length, window.slide)
    if isinstance(window, Session):
        return F.session_window(ts, window.gap)
    raise ValueError(f"no time window: {window}")


def windowed(df: DataFrame, window, measures: list[Measure] | None = None, keys: tuple[str, ...] = (), ts: str = "ts", order: str | None = None, watermark: str | None = None) -> DataFrame:
    """One row for each key and window: keys, ``window_start``, ``window_end`` and the measures.

    Count windows take ``order`` as tie-break and give ``window_number``
    instead; on streams they need :func:`streaming_count_windows`.  A
    watermark drops events later than that behind the latest.
    """
    measures = measures or [Measure("count")]
    custom = [m for m in measures if m.custom]
    df = event_time(df, ts)
    if watermark:
        df = df.withWatermark(ts, watermark)
    if isinstance(window, Global):
        return df.groupBy(*keys).agg(*(measure(m, df.isStreaming) for m in measures if not m.custom))
    if isinstance(window, Count):
        if df.isStreaming:
            raise ValueError("use streaming_count_windows on a stream")
        if keys:
            place = F.row_number().over(Window.partitionBy(*keys).orderBy(ts, *([order] if order else []))) - 1
            df = df.withColumn("_place", place)
        else:
            df = running_rank(df, [F.col(ts), *([F.col(order)] if order else [])], "_place")
        by = [*keys, F.floor(F.col("_place") / window.events).cast("long").alias("window_number")]
        return df.groupBy(*by).agg(F.min(ts).alias("window_start"), F.max(ts).alias("window_end"), *(measure(m) for m in measures if not m.custom))
    by = window_column(window, ts)
    if custom:
        return _custom(df, by, measures, keys)
    grouped = df.groupBy(*keys, by.alias("w")).agg(*(measure(m, df.isStreaming) for m in measures))
    return grouped.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *(m.alias() for m in measures))


def _custom(df: DataFrame, by: Column, measures: list[Measure], keys: tuple[str, ...]) -> DataFrame:
    """Measures written in Python get a window's events as one pandas frame."""
    if any(not m.custom for m in measures):
        raise ValueError("custom measures stand alone")
    fields = [df.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("window_start", T.TimestampType()), T.StructField("window_end", T.TimestampType()), *(T.StructField(m.alias(), T.DoubleType()) for m in measures)])
    flat = df.withColumn("_w", by).withColumn("window_start", F.col("_w.start")).withColumn("window_end", F.col("_w.end")).drop("_w")

    def fold(events: pd.DataFrame) -> pd.DataFrame:
        row = {c: events[c].iloc[0] for c in (*keys, "window_start", "window_end")}
        return pd.DataFrame([{**row, **{m.alias(): float(m.custom(events)) for m in measures}}])

    return flat.groupBy(*keys, "window_start", "window_end").applyInPandas(fold, schema)


def streaming_count_windows(df: DataFrame, size: int, key: str, value: str, key_type: str = "long") -> DataFrame:
    """Windows of ``size`` events for each key on a stream: ``key, window_number, count, sum``.

    The state is the open window's count and sum; full windows are emitted as
    they close, the open one stays.
    """

    def fold(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        number, count, total = state.get if state.exists else (0, 0, 0.0)
        rows = []
        for frame in frames:
            for x in frame[value].tolist():
                count, total = count + 1, total + (0.0 if x is None or x != x else float(x))
                if count == size:
                    rows.append((group[0], number, count, total))
                    number, count, total = number + 1, 0, 0.0
        state.update((number, count, total))
        yield pd.DataFrame(rows, columns=[key, "window_number", "count", "sum"])

    return df.select(key, value).groupBy(key).applyInPandasWithState(fold, f"`{key}` {key_type}, window_number long, count long, sum double", "number long, count long, total double", "append", "NoTimeout")


def late_events(df: DataFrame, tolerance: str, ts: str = "ts", arrival: str = "arrival") -> DataFrame:
    """How many events came later than ``tolerance`` behind the latest event that had arrived: one row ``events, late``.

    Latest times are taken by hour of arrival and then within it, so no task
    sees more than an hour.
    """
    df = event_time(event_time(df, ts), arrival).withColumn("_hour", F.date_trunc("hour", arrival))
    hours = df.groupBy("_hour").agg(F.max(ts).alias("_most"))
    before = Window.orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    earlier = hours.select("_hour", F.max("_most").over(before).alias("_earlier"))
    own = Window.partitionBy("_hour").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.greatest(F.max(ts).over(own), F.col("_earlier"))
    late = F.col(ts) < seen - F.expr(f"interval {tolerance}")
    return df.join(earlier, "_hour").withColumn("_late", late).agg(F.count("*").alias("events"), F.coalesce(F.sum(F.col("_late").cast("long")), F.lit(0).cast("long")).alias("late"))
