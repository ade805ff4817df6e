"""Reading and writing byte ranges of files on any file system that a URI names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme: without one it lies on the cluster's default file system, not on each machine's disk."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(target).toString()


def _located(uri: str):
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), uri
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    # the same store under the name that Arrow knows it by
    return fs.FileSystem.from_uri(f"s3:{rest}" if scheme in ("s3a", "s3n") else uri)


def opened(uri: str):
    """A seekable file at a URI as :func:`qualified` makes it; a plain path is this machine's."""
    system, path = _located(uri)
    return system.open_input_file(path)


def created(uri: str):
    system, path = _located(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path)


def ranges(spark: SparkSession, path: str, size: int, pattern: str = "*") -> DataFrame:
    """``path, start, stop, length`` of every ``size`` bytes of the files in ``path``.

    Only names and lengths are listed; no content is read.  Ranges are dealt
    out evenly.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).where("length > 0").select("path", "length")
    cut = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))))
    cut = cut.select("path", "start", F.least("length", F.col("start") + size).alias("stop"), "length")
    return cut.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")
