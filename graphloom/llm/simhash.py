"""Near-duplicates by SimHash fingerprints that differ in few bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.components import star_roots

from .hammingtrie import SEGMENTS, WHOLE, Shape, forest, merge, prefix_budgets
from .storage import free_name, saved

SHINGLE_WORDS = 4
ERRORS = 4
SEED = 42
BLOCK_ROWS = 100_000
BATCH_ROWS = 200_000


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of a text's word shingles, as an unsigned number.

    ASCII letters are lower-cased; words are runs of other than ASCII white
    space; shingles are ``words`` words joined by one space, or all words where
    there are fewer.  A bit is set when over half of the shingles' XXH64 have
    it.  No words give 0.
    """
    from xxhash import xxh64_digest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return int.from_bytes(xxh64_digest(joined, SEED), "big")
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(found) - words + 1].tolist()
    ends = (ends[words - 1 :] - 1).tolist()
    digests = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, ends)])
    counts = bit_counts(np.frombuffer(digests, np.uint8).reshape(-1, 8))
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many rows of bytes have each bit, the highest bit of the first byte first."""
    counts = np.zeros(8 * rows.shape[1], np.int64)
    for at in range(0, len(rows), 1 << 13):
        bits = np.unpackbits(rows[at : at + (1 << 13)], axis=1).view(np.uint64)
        # eight counters to a word; 255 rows can't overflow one
        sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)
        counts += sums.view(np.uint8).reshape(len(sums), -1).sum(axis=0, dtype=np.int64)
    return counts


def fingerprints(docs: DataFrame, key: str = "doc_id", extra: dict[str, Column] | None = None, words: int = SHINGLE_WORDS) -> DataFrame:
    """``key, fp`` (the 64 bits as a long) of every whole text, and ``extra`` columns."""
    extra = extra or {}
    narrow = docs.select("text", F.col(key), *(c.alias(k) for k, c in extra.items()))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "text")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, words) for t in texts(batch.column(0))), np.uint64, batch.num_rows)
            columns = [*batch.columns[1:], pa.array(fps.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[1:], "fp"])

    return narrow.mapInArrow(add, f"{fields}, fp long")


def texts(column: pa.Array) -> Iterator[str | None]:
    for at in range(0, len(column), 64):
        yield from column.slice(at, 64).to_pylist()


def near_pairs(fps: DataFrame, errors: int = ERRORS) -> DataFrame:
    """Links ``a, b`` that join all distinct ``fp`` within ``errors`` bits of each other.

    Each fingerprint is read from five starts of its ring of bits; those with
    the same leading segment form a block, joined on a trie of its own.  A
    block's links are cut down to a forest of its components.
    """
    if not 0 <= errors < SEGMENTS:
        raise ValueError(f"errors must be from 0 to {SEGMENTS - 1}")
    bits = WHOLE.segment
    turned = [F.struct(F.lit(r).cast("int").alias("turn"), _turned("fp", bits * r).alias("bits")) for r in range(SEGMENTS)]
    turns = fps.select("fp", F.explode(F.array(*turned)).alias("t")).select("fp", "t.turn", "t.bits")
    first = F.when(F.col("turn") == SEGMENTS - 1, F.shiftrightunsigned("bits", 64 - WHOLE.root)).otherwise(F.shiftrightunsigned("bits", 64 - bits))
    turns = turns.select((first * SEGMENTS + F.col("turn")).cast("int").alias("block"), "bits", F.col("fp").alias("id"))
    return trie_links(turns, turns.groupBy("block").count(), WHOLE, errors)


def trie_links(turns: DataFrame, sizes: DataFrame, shape: Shape, errors: int, most: int = 64) -> DataFrame:
    """Links ``a, b`` of ``id`` that join the rows ``block, bits, id`` (and words to verify pairs by) of one block.

    ``sizes (block, count)`` tells which blocks are split: one of more than
    ``BLOCK_ROWS`` is cut at a node pair's next levels.  A value below a node
    meets those below the same node and, within the error budget of the second
    segment (one bit), those below each node that differs in one bit, so a
    value is repeated once more for each level, whatever the number of rows.
    """
    deeper = int(min(1, prefix_budgets(errors, shape)[min(64, shape.root + shape.segment - 1)]))
    marks = [c for c in turns.columns if c not in ("block", "bits", "id")]
    levels = F.least(F.lit(shape.segment - 1), F.ceil(F.log2(F.col("count") / BLOCK_ROWS))).cast("int")
    hot = sizes.where(F.col("count") > BLOCK_ROWS).select("block", levels.alias("split"))
    dealt = turns.join(F.broadcast(hot), "block", "left").withColumn("split", F.coalesce("split", F.lit(0)))
    # the bits after the root
    own = F.when(F.col("split") == 0, F.lit(0)).otherwise(F.expr(f"shiftrightunsigned(shiftrightunsigned(shiftleft(bits, {shape.root}), 1), 63 - split)"))
    dealt = dealt.withColumn("_own", own.cast("int"))
    dealt = dealt.withColumn("_flip", F.explode(F.sequence(F.lit(0), F.col("split") * deeper)))
    other = F.when(F.col("_flip") == 0, F.col("_own")).otherwise(F.col("_own").bitwiseXOR(F.expr("shiftleft(1, _flip - 1)")))
    dealt = dealt.withColumn("_other", other)
    dealt = dealt.select("block", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "split", "bits", "id", *marks)
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            # a run of whole cells: cut where the cell changes once enough rows are held
            while batch.num_rows:
                cut = 0
                if rows >= BATCH_ROWS:
                    ids = _cells(batch)
                    changed = np.flatnonzero(ids != _cells(held[-1].slice(held[-1].num_rows - 1))[-1])
                    cut = int(changed[0]) if len(changed) else batch.num_rows
                    if cut:
                        held.append(batch.slice(0, cut))
                    batch = batch.slice(cut)
                    if batch.num_rows:
                        yield _linked(held, shape, errors, most)
                        held, rows = [], 0
                else:
                    held.append(batch)
                    rows += batch.num_rows
                    batch = batch.slice(batch.num_rows)
        if held:
            yield _linked(held, shape, errors, most)

    ordered = dealt.repartition(parts, "block", "i", "j").sortWithinPartitions("block", "i", "j")
    return ordered.mapInArrow(join, "a long, b long").distinct()


def _turned(name: str, bits: int) -> Column:
    if not bits:
        return F.col(name)
    return F.shiftleft(name, bits).bitwiseOR(F.shiftrightunsigned(name, 64 - bits))


def _cells(batch: pa.RecordBatch) -> np.ndarray:
    block, i, j = (batch.column(k).to_numpy().astype(np.int64) for k in range(3))
    return (block << 32) | (i << 16) | j


def _linked(held: list[pa.RecordBatch], shape: Shape, errors: int, most: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(held)
    cells = np.concatenate([_cells(b) for b in held])
    split, bits, own, *words = (table.column(k).to_numpy() for k in range(3, table.num_columns))
    order = np.lexsort((bits.view(np.uint64), cells))
    cells, bits, own = cells[order], bits[order].view(np.uint64), own[order]
    marks = np.stack(words, axis=1)[order].view(np.uint64) if words else None
    starts = np.concatenate(([0], np.flatnonzero(np.diff(cells)) + 1, [len(cells)]))
    first = cells[starts[:-1]]
    crossed = ((first >> 16) & 0xFFFF) != (first & 0xFFFF)
    label = forest(bits, starts, errors, shape, split[order][starts[:-1]].astype(np.int64), crossed, marks, most)
    # one forest over all blocks at hand, by ids: its stars stand on the least id, so that other batches give the same links again
    ids, at = np.unique(own, return_inverse=True)
    home = np.arange(len(ids))
    merge(home, at, at[label])
    member = np.flatnonzero(home != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(ids[home[member]]), pa.array(ids[member])], names=["a", "b"])


def simhash_components(docs: DataFrame, errors: int = ERRORS, key: str = "doc_id", words: int = SHINGLE_WORDS) -> DataFrame:
    """``key, fingerprint, component_id`` for every row of ``docs``.

    Fingerprints within ``errors`` bits are linked, whatever their documents
    (null and empty texts have fingerprint 0); ``component_id`` is the least
    key that can be reached, the row's own included; it is null where no
    document of the component has a key.  Equal fingerprints are joined as
    one, so copies cost one row from each task.
    """
    marked = saved(fingerprints(docs, key, words=words), "fingerprints")
    homes = component_table(marked.withColumn("_least", F.col(key)), errors).select("fp", F.col("_least").alias("component_id"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(homes, "fp").select(key, text.alias("fingerprint"), "component_id")


def component_table(marked: DataFrame, errors: int) -> DataFrame:
    """For each ``fp`` of ``marked (fp, _least)`` its component's ``root`` and least ``_least``."""
    fps = saved(marked.groupBy("fp").agg(F.min("_least").alias("_least")), "fps")
    roots = star_roots(near_pairs(fps.select("fp"), errors))
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "_least")
    least = rooted.groupBy("root").agg(F.min("_least").alias("_least"))
    return rooted.drop("_least").join(least, "root")


def one_of_each(docs: DataFrame, errors: int = ERRORS, key: str = "doc_id", words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` that stand for their component: the least key, then the least MD5 of the text.

    Columns stay as they are.  A row without key stays only where its
    component has no row with one; of repeated rows one stays.
    """
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    marked = saved(fingerprints(docs, key, {"_md5": digest}, words), "fingerprints")
    ranked = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("_md5").alias("md5"))
    homes = component_table(marked.withColumn("_least", ranked), errors)
    return standing_rows(docs, homes, key)


def standing_rows(docs: DataFrame, homes: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` with the key and the text's MD5 of a ``_least`` of ``homes``, repeated rows once."""
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    chosen = homes.select(F.col("_least.key").alias("_key"), F.col("_least.md5").alias("_chosen")).distinct()
    mark = free_name(docs, "_md5")
    with_mark = docs.withColumn(mark, digest)
    kept = with_mark.join(chosen, with_mark[key].eqNullSafe(chosen["_key"]) & (with_mark[mark] == chosen["_chosen"]), "left_semi")
    return kept.dropDuplicates([key, mark]).drop(mark)
