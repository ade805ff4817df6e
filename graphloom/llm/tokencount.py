"""Token counts from flat token files that have no index, by scanning for the separator."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byteranges import created, opened, qualified
from .storage import saved
from .tokens import encoder, vocabulary_paths

SEPARATOR = 50_256
WIDTH = 2
BLOCK_TOKENS = 1 << 20


def write_flat(docs: DataFrame, path: str, paths: tuple[str, str] | None = None, separator: int = SEPARATOR, key: str = "doc_id") -> DataFrame:
    """Write each document's ids and the separator to flat files of unsigned 16-bit ids under ``path``.

    Each task writes one file of a name of its own, so a repeated task leaves
    the first try's file unread.  Returns ``file, ordinal, key``: which
    documents a file holds, in order, without their places.
    """
    paths, path = paths or vocabulary_paths(), qualified(docs.sparkSession, path)
    kind = docs.schema[key].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file, ordinal = f"{path}/{uuid.uuid4().hex}.tokens", None, 0
        encode, end = encoder(paths, WIDTH).encode, np.asarray([separator], f"<u{WIDTH}").tobytes()
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    file = file or created(name)
                    for text in part.column(1).to_pylist():
                        file.write(encode(text or "") + end)
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(ordinal, ordinal + n)), part.column(0)], names=["file", "ordinal", key])
                    ordinal += n
        finally:
            if file:
                file.close()

    return saved(docs.select(key, "text").mapInArrow(write, f"file string, ordinal long, `{key}` {kind}"), "token-files")


def scan_blocks(blocks: DataFrame, separator: int = SEPARATOR, width: int = WIDTH) -> DataFrame:
    """For rows ``file, block, first, tokens`` the separators of each block.

    ``ends``: how many there are; ``lengths``: the tokens before the first and
    between each two, ``tail``: those after the last.
    """
    schema = "file string, block long, ends long, lengths array<long>, tail long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with opened(r["file"]) as file:
                    file.seek(r["first"] * width)
                    ids = np.frombuffer(file.read(r["tokens"] * width), f"<u{width}")
                at = np.flatnonzero(ids == separator)
                lengths = np.diff(np.concatenate(([-1], at))) - 1
                tail = len(ids) - (int(at[-1]) + 1 if len(at) else 0)
                yield pa.RecordBatch.from_arrays([pa.array([r["file"]]), pa.array([r["block"]]), pa.array([len(at)]), pa.array([lengths], pa.list_(pa.int64())), pa.array([tail])], names=["file", "block", "ends", "lengths", "tail"])

    return blocks.mapInArrow(scan, schema)


def stitch(scanned: DataFrame) -> DataFrame:
    """``file, ordinal, n_tokens`` of every document: block counts are added up along each file.

    A document's first block gives the tokens after its predecessor, whole
    blocks without separator all of theirs, and its last block those before
    the separator.  What a file holds after its last separator is no document.
    The prefix scan reads four numbers a block; lengths join its offsets after.
    """
    kept = saved(scanned, "blocks")
    slim = kept.select("file", "block", "ends", "tail")
    along = Window.partitionBy("file").orderBy("block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    own = slim.withColumn("_docs", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    # stretches of blocks that begin with one that has a separator: tails add up within them
    stretch = Window.partitionBy("file", "_stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumn("_stretch", F.sum(F.when(F.col("ends") > 0, 1).otherwise(0)).over(along))
    own = own.withColumn("_open", F.sum("tail").over(stretch)).withColumn("_carry", F.coalesce(F.lag("_open").over(along), F.lit(0)))
    places = own.where("ends > 0").select("file", "block", "_docs", "_carry")
    each = kept.select("file", "block", "lengths").join(places.hint("merge"), ["file", "block"])
    each = each.select("file", "_docs", "_carry", F.posexplode("lengths").alias("_at", "_length"))
    return each.select("file", (F.col("_docs") + F.col("_at")).alias("ordinal"), (F.col("_length") + F.when(F.col("_at") == 0, F.col("_carry")).otherwise(0)).alias("n_tokens"))


def file_blocks(files: DataFrame, block_tokens: int = BLOCK_TOKENS, width: int = WIDTH) -> DataFrame:
    """``file, block, first, tokens`` over the files named in ``files (file)``; only their lengths are asked for."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            sizes = []
            for name in names:
                with opened(name) as file:
                    sizes.append(file.size() // width)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["file", "n"])

    sized = files.mapInArrow(measure, "file string, n long").where("n > 0")
    cut = sized.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block_tokens).cast("long"))))
    cut = cut.select("file", "block", (F.col("block") * block_tokens).alias("first"), F.least(F.lit(block_tokens).cast("long"), F.col("n") - F.col("block") * block_tokens).alias("tokens"))
    return cut.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "block")


def count_tokens(docs: DataFrame, path: str, paths: tuple[str, str] | None = None, block_tokens: int = BLOCK_TOKENS, key: str = "doc_id") -> DataFrame:
    """``key, n_tokens`` of every document, counted on flat files written under ``path``.

    A null or empty text has no tokens; repeated rows are counted each; an
    empty table gives no rows.
    """
    members = write_flat(docs, path, paths, key=key)
    counts = stitch(scan_blocks(file_blocks(members.select("file").distinct(), block_tokens)))
    # file names compress so well that the size Spark sees says little: never broadcast
    return members.join(counts.hint("merge"), ["file", "ordinal"]).select(key, "n_tokens")
