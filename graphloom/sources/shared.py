"""Tables kept for the length of a session in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DIR = "/tmp/checkpoints/graphloom"
#: A task that reads or writes a row group holds it whole, so a JVM with many cores needs small ones.
GROUP_BYTES = 16 << 20
_kept: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local folder only where a local master leaves it unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_DIR


def new_dir(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _kept:
        atexit.register(_clean)
    _kept.append(path)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read again, so that later steps neither repeat nor lose it."""
    path = new_dir(df.sparkSession, name)
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._kept_path = path
    return kept


def discard(*kept: DataFrame) -> None:
    """Delete tables of :func:`saved` that nothing will read again, and the shuffle files behind them.

    Spark's cleaner drops shuffle files of finished jobs when the driver
    collects garbage, in the background.
    """
    spark = kept[0].sparkSession
    for df in kept:
        remove(spark, df._kept_path)
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for path in _kept if spark else ():
        try:
            remove(spark, path)
        except Exception:  # the gateway may be gone at exit
            return
    _kept.clear()

