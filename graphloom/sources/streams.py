"""Streaming sources, decoding of payloads, and a manager of running queries."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Fixed columns of a decoded event stream.
EVENT_SCHEMA = "event_id string, event_type string, ts timestamp, source string, priority int, watermark long, metadata map<string,string>, payload string"
MOST_SOURCES = 100


def replay(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1, pattern: str = "*.parquet") -> DataFrame:
    """A stream of a folder's Parquet files, some at a time (the back-pressure of a file source)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(folder)


def files(spark: SparkSession, path: str, form: str, schema: str, files_per_trigger: int = 100, **options) -> DataFrame:
    """A stream of JSON, CSV, XML, Parquet, ORC or text files as they arrive."""
    return spark.readStream.format(form).schema(schema).options(**options).option("maxFilesPerTrigger", files_per_trigger).load(path)


def kafka(spark: SparkSession, servers: str, topics: str, offsets_per_trigger: int = 1_000_000, **options) -> DataFrame:
    """``key, value`` texts of Kafka topics; the session needs Spark's Kafka package."""
    found = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("maxOffsetsPerTrigger", offsets_per_trigger).options(**options).load()
    return found.select(F.col("key").cast("string"), F.col("value").cast("string"), "topic", F.col("timestamp").alias("ts"))


def socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def rate(spark: SparkSession, rows_per_second: int = 100) -> DataFrame:
    """Made-up events ``ts, value`` for trials."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().withColumnRenamed("timestamp", "ts")


def decode(df: DataFrame, form: str, schema: str, column: str = "value", options: dict[str, str] | None = None) -> DataFrame:
    """``column``'s text as typed columns: json, csv or xml; unreadable rows have nulls."""
    readers = {"json": F.from_json, "csv": F.from_csv, "xml": F.from_xml}
    if form not in readers:
        raise ValueError(f"no decoder for {form}")
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, readers[form](F.col(column), schema, options or {}).alias("_d")).select(*rest, "_d.*")


@dataclass
class SourceManager:
    """Named streams: added, started, stopped, looked after and restarted when they failed."""

    most: int = MOST_SOURCES
    most_restarts: int = 3
    clock: Callable[[], float] = time.time
    builders: dict[str, Callable[[], StreamingQuery]] = field(default_factory=dict)
    running: dict[str, StreamingQuery] = field(default_factory=dict)
    restarts: dict[str, int] = field(default_factory=dict)
    started: dict[str, float] = field(default_factory=dict)

    def add(self, name: str, start: Callable[[], StreamingQuery]) -> None:
        if name in self.builders:
            raise ValueError(f"source {name} exists")
        if len(self.builders) >= self.most:
            raise OverflowError(f"more than {self.most} sources")
        self.builders[name] = start

    def remove(self, name: str) -> None:
        self.stop(name)
        del self.builders[name]

    def start(self, name: str) -> StreamingQuery:
        if name not in self.running or not self.running[name].isActive:
            self.running[name], self.started[name] = self.builders[name](), self.clock()
        return self.running[name]

    def stop(self, name: str) -> None:
        query = self.running.pop(name, None)
        if query:
            query.stop()

    def status(self, name: str) -> str:
        query = self.running.get(name)
        if query is None:
            return "stopped"
        if query.isActive:
            return "running"
        return "failed" if query.exception() else "finished"

    def stats(self, name: str) -> dict:
        query = self.running.get(name)
        last = query.lastProgress if query else None
        return {"status": self.status(name), "restarts": self.restarts.get(name, 0), "rows": sum(p["numInputRows"] for p in query.recentProgress) if query else 0, "last_batch": last["batchId"] if last else None}

    def check(self) -> dict[str, str]:
        """Every source's status, after restarting those that failed, each at most ``most_restarts`` times."""
        for name in self.builders:
            if self.status(name) == "failed" and self.restarts.get(name, 0) < self.most_restarts:
                self.restarts[name] = self.restarts.get(name, 0) + 1
                self.running.pop(name)
                self.start(name)
        return {name: self.status(name) for name in self.builders}
