"""Packing documents' tokens into windows of equal length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .differencing import pack_into_windows
from .storage import saved
from .tokens import encoder, vocabulary_paths

WINDOW = 2048
TAIL_PIECE = 512
GROUP_WINDOWS = 64


def token_pieces(docs: DataFrame, paths: tuple[str, str] | None = None, separator: int = 1, window: int = WINDOW, tail: int = TAIL_PIECE, digest: bool = False, key: str = "doc_id") -> DataFrame:
    """Each document's ids and the separator, cut into pieces.

    Whole windows come first; what is left is cut into pieces of ``tail`` so
    that differencing can level them.  Returns ``key, start, length,
    doc_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit), or with
    ``digest`` their CRC-32 as ``ids_crc32``.  A null text is empty: its one
    piece is the separator.  Other columns are left out.
    """
    paths = paths or vocabulary_paths()
    last = "ids_crc32 long" if digest else "ids binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(paths).encode, np.asarray([separator], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encode(text or "") + end
                    n, start = len(ids) // 4, 0
                    while start < n:
                        length = window if n - start >= window else min(tail, n - start)
                        piece = ids[4 * start : 4 * (start + length)]
                        rows.append((doc, start, length, n, zlib.crc32(piece) if digest else piece))
                        start += length
                columns = zip(*rows) if rows else [[]] * 5
                kinds = [part.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(columns, kinds)], names=[key, "start", "length", "doc_tokens", last.split()[0]])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(cut, f"{key} {kind}, start long, length long, doc_tokens long, {last}")


def pack(pieces: DataFrame, window: int = WINDOW, group_windows: int = GROUP_WINDOWS, key: str = "doc_id") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``key, start, length``.

    Pieces are dealt by a hash of ``key`` and ``start`` into groups of about
    ``group_windows`` windows, so one long document or many copies spread over
    all groups.  In a group, whole windows stand alone and the others are
    levelled by multiway differencing.  Only a group's pieces are ever held in
    one task.  Ids are unique, not gapless; offsets are gapless in a sequence.
    Reruns over the same rows agree.  No rows give no rows.
    """
    total = pieces.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, round(total / (window * group_windows)))
    grouped = pieces.withColumn("_group", F.pmod(F.xxhash64(F.col(key), F.col("start"), F.col("length")), F.lit(groups)).cast("long"))
    schema = grouped.schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name != "_group")
    names = [f.name for f in schema]

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []
        for batch in batches:
            groups = batch.column(names.index("_group")).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if pending and pending[-1].column(names.index("_group"))[0].as_py() != int(groups[a]):
                    yield from placed(pending)
                    pending = []
                pending.append(batch.slice(a, b - a))
        if pending:
            yield from placed(pending)

    def placed(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).combine_chunks()
        group = table.column("_group")[0].as_py()
        lengths = table.column("length").to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        whole = np.flatnonzero(lengths == window)
        rest = np.flatnonzero(lengths != window)
        sequence[whole] = np.arange(len(whole))
        made = len(whole)
        # a group may be far larger than planned: levelled in runs of bounded total
        bounds = np.cumsum(lengths[rest]) // (2 * window * group_windows)
        for run in np.split(rest, np.flatnonzero(np.diff(bounds)) + 1):
            for items in pack_into_windows(lengths[run].tolist(), window):
                own = run[np.asarray(items)]
                sequence[own] = made
                offset[own] = np.cumsum(lengths[own]) - lengths[own]
                made += 1
        table = table.drop_columns(["_group"]).append_column("sequence_id", pa.array(sequence + (group << 32))).append_column("offset", pa.array(offset))
        yield from table.to_batches(max_chunksize=10_000)

    spark = pieces.sparkSession
    parts = max(1, min(groups, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ordered = grouped.repartition(parts, "_group").sortWithinPartitions("_group", key, "start", "length")
    return ordered.mapInArrow(level, f"{fields}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, paths: tuple[str, str] | None = None, digest: bool = False) -> DataFrame:
    """Pieces of all documents with their places; tokenised once and kept in the shared folder."""
    return pack(saved(token_pieces(docs, paths, digest=digest), "pieces"))
