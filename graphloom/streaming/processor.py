"""Running streams: into tables, into views, and once over what there is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.plans.maintenance import Engine
from graphloom.sources.shared import new_dir


def deduplicated(df: DataFrame, watermark: str, ts: str = "ts", key: str = "event_id") -> DataFrame:
    """One event of each key; the state forgets keys older than the watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def shed(df: DataFrame, least_priority: int, priority: str = "priority") -> DataFrame:
    """Drops events below a priority, as a controlled answer to overload; null priorities stay."""
    return df.where(F.col(priority).isNull() | (F.col(priority) >= least_priority))


def start(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    """A query that hands each micro-batch to ``sink``; the checkpoint makes it resume where it stopped."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(sink).start()


def drained(df: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that its source holds now, and read the result.

    ``complete`` keeps the last batch's rows, ``append`` and ``update`` keep
    each batch's in a folder of its own, so a repeated batch replaces itself.
    """
    spark = df.sparkSession
    out, marks = new_dir(spark, "stream"), new_dir(spark, "stream-marks")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={0 if mode == 'complete' else number}")

    start(df, sink, marks, mode).awaitTermination()
    return spark.read.schema(df.schema).parquet(out).drop("batch")


def maintain(changes: DataFrame, engine: Engine, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Feed a change stream to an engine; a batch that is tried again is folded once."""
    return start(changes, lambda batch, number: engine.process(batch, number), checkpoint, trigger=trigger)
