"""Near-duplicates of a given Jaccard similarity: SimHash windows joined on tries, then exact sets.

Sets of similarity 0.8 differ in about 15 % of their SimHash bits, more than
one fingerprint of 64 bits can be searched for.  So a set gets sixteen
independent windows of 40 bits, each joined with an error budget of four, and
128 further bits that a pair must come near in as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.components import star_roots

from .hammingtrie import SEGMENTS, WINDOW
from .simhash import SEED, bit_counts, standing_rows, texts, trie_links
from .storage import saved

SHINGLE_WORDS = 5
LEAST_SHARED, OF_UNION = 4, 5  # a link has at least 4/5 of the union in common
BLOCK_SHINGLES = 1_000_000

WINDOWS = 16
WINDOW_ERRORS = 4
WINDOW_BYTES = 5
MARK_BITS = 128
MOST_MARK_BITS = 36  # four standard deviations above the mean at similarity 0.8
_WORDS = (8 * WINDOWS * WINDOW_BYTES + MARK_BITS) // 64
_STEPS = np.arange(1, _WORDS + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The set of a text's shingles as sorted XXH64; words and shingles are those of ``simhash.fingerprint``."""
    from xxhash import xxh64_digest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    return np.unique(np.frombuffer(b"".join([xxh64_digest(g, SEED) for g in grams]), np.uint64))


def set_id(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(hashes.tobytes(), SEED)


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """768 SimHash bits of a set of shingle hashes: sixteen windows of 40, then 128; none for an empty set.

    Each hash is mixed with twelve steps into as many independent words.  A
    bit is set when over half of the words have it; at a tie, when the set's
    least hash has it, so that tied bits of unlike sets differ.
    """
    if not len(hashes):
        return b""
    z = hashes[None, :] + _STEPS
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    words = np.ascontiguousarray(z.T).view(np.uint8)
    first = np.unpackbits(words[int(hashes.argmin())]).astype(np.int64)
    return np.packbits(2 * bit_counts(words) + first > len(hashes)).tobytes()


def window_turns(sets: DataFrame) -> DataFrame:
    """``block, bits, id, m1, m2`` of rows ``sid, wide``: each window from each of its five segments on.

    ``bits`` holds the turned window and, below it, 24 bits of the marks;
    ``block`` is the window, the turn and the leading segment.
    """

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                wide = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                rings = wide[:, : WINDOWS * WINDOW_BYTES].reshape(-1, WINDOWS, WINDOW_BYTES)
                marks = wide[:, WINDOWS * WINDOW_BYTES :]
                bits = np.zeros((len(wide), WINDOWS, SEGMENTS, 8), np.uint8)
                for r in range(SEGMENTS):
                    bits[:, :, r, :WINDOW_BYTES] = np.roll(rings, -r, axis=2)
                bits[:, :, :, WINDOW_BYTES:] = marks[:, None, None, :3]
                block = (np.arange(WINDOWS * SEGMENTS, dtype=np.int32).reshape(WINDOWS, SEGMENTS) << 8) | bits[..., 0]
                times = WINDOWS * SEGMENTS
                ids = np.repeat(batch.column(0).to_numpy(), times)
                halves = np.ascontiguousarray(marks).view(np.int64)
                arrays = [block.reshape(-1).astype(np.int32), bits.view(">i8").astype(np.int64).reshape(-1), ids, np.repeat(halves[:, 0], times), np.repeat(halves[:, 1], times)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["block", "bits", "id", "m1", "m2"])

    return sets.mapInArrow(turn, "block int, bits long, id long, m1 long, m2 long")


def window_sizes(sets: DataFrame) -> DataFrame:
    """``block, count`` of :func:`window_turns`, counted in batches before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((WINDOWS * SEGMENTS, 256), np.int64)
        for batch in batches:
            if batch.num_rows:
                wide = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                for k in range(len(sums)):
                    sums[k] += np.bincount(wide[:, k], minlength=256)
        block = np.flatnonzero(sums.reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array(sums.reshape(-1)[block])], names=["block", "count"])

    return sets.select("wide").mapInArrow(count, "block int, count long").groupBy("block").agg(F.sum("count").alias("count"))


def linked_sets(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs ``i, j`` of positions that join all sets as similar as a link asks, a forest of their components.

    A set found is compared with all sets not found yet, so a group of like
    sets costs about as much as it has members.
    """
    values, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    own = [tokens[a:b] for a, b in zip(ends - sizes, ends)]
    mark = np.zeros(len(values), bool)
    open_, held = np.ones(len(sets), bool), np.arange(len(sets))
    starts, pairs = ends - sizes, []
    for seed in range(len(sets)):
        todo = [seed] if open_[seed] else []
        open_[seed] = False
        while todo:
            left = int(open_.sum())
            if not left:
                return pairs
            if 2 * left <= len(held):
                held = np.flatnonzero(open_)
                tokens = np.concatenate([own[i] for i in held])
                starts = np.cumsum(sizes[held]) - sizes[held]
            at = todo.pop()
            mark[own[at]] = True
            common = np.add.reduceat(mark[tokens], starts, dtype=np.int64)
            mark[own[at]] = False
            found = held[(OF_UNION * common >= LEAST_SHARED * (sizes[at] + sizes[held] - common)) & open_[held]].tolist()
            open_[found] = False
            pairs += [(at, i) for i in found]
            todo += found
    return pairs


def set_table(docs: DataFrame, key: str, words: int) -> DataFrame:
    """``key``, the text's MD5, ``sid, size`` of its shingle set and the set's ``wide`` fingerprint."""
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    narrow = docs.select("text", F.col(key), digest.alias("_md5"))
    kind = narrow.schema[1].dataType.simpleString()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(set_id(h), len(h), wide_fingerprint(h)) for h in (shingle_hashes(t, words) for t in texts(batch.column(0)))]
            ids, sizes = np.array([s[0] for s in sets], np.uint64).view(np.int64), np.array([s[1] for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(ids), pa.array(sizes), pa.array([s[2] for s in sets], pa.binary())], names=[key, "_md5", "sid", "size", "wide"])

    return narrow.mapInArrow(add, f"`{key}` {kind}, _md5 string, sid long, size long, wide binary")


def set_hashes(docs: DataFrame, words: int) -> DataFrame:
    """``sid, hashes`` of every text that has a shingle, a set once."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = {set_id(h): h.tobytes() for h in (shingle_hashes(t, words) for t in texts(batch.column(0).slice(at, 256))) if len(h)}
                yield pa.RecordBatch.from_arrays([pa.array(np.array(list(sets), np.uint64).view(np.int64)), pa.array(sets.values(), pa.binary())], names=["sid", "hashes"])

    return docs.select("text").mapInArrow(add, "sid long, hashes binary").dropDuplicates(["sid"])


def similar_pairs(docs: DataFrame, sets: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """Links ``a, b`` that join all ``sid`` whose sets are as similar as a link asks.

    Candidates are sets that share a window within its error budget and come
    near in the marks.  Each component of candidates is joined exactly in a
    task, with whole sets.  One of more than ``BLOCK_SHINGLES`` shingles is
    dealt by hash into chunks, and every two chunks share a task, so no two
    sets of a component go untested.
    """
    one = sets.select("sid", "wide").where("length(wide) > 0").dropDuplicates(["sid"])
    one = saved(one, "wide-sets")
    ties = trie_links(window_turns(one), window_sizes(one), WINDOW, WINDOW_ERRORS, MOST_MARK_BITS)
    roots = saved(star_roots(ties), "candidates")
    homes = roots.select(F.col("node").alias("sid"), "root").unionByName(roots.select(F.col("root").alias("sid"), "root").distinct())
    homes = homes.join(sets.select("sid", "size").dropDuplicates(["sid"]), "sid")
    chunks = homes.groupBy("root").agg(F.ceil(F.sum("size") / BLOCK_SHINGLES).cast("int").alias("chunks"))
    dealt = homes.drop("size").join(chunks, "root")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("sid", F.lit("chunk")), F.col("chunks")).cast("int"))
    dealt = dealt.join(set_hashes(docs, words), "sid").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "sid", "hashes")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, held = None, [], []

        def linked() -> pa.RecordBatch:
            pairs = linked_sets(held) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for root, i, j, own, hashes in zip(*(c.to_pylist() for c in batch.columns)):
                if cell != (root, i, j):
                    yield linked()
                    cell, ids, held = (root, i, j), [], []
                ids.append(own)
                held.append(np.frombuffer(hashes, np.uint64))
        yield linked()

    ordered = dealt.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j")
    return ordered.mapInArrow(join, "a long, b long").distinct()


def one_of_each(docs: DataFrame, key: str = "doc_id", words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` that stand for their group: the least key, then the least MD5 of the text.

    Texts are linked when their shingle sets have a Jaccard similarity of at
    least 0.8, groups are the links' components; texts without words are one
    group.  Columns stay as they are.  A row without key stays only where its
    group has no row with one; of repeated rows one stays.
    """
    sets = saved(set_table(docs, key, words), "shingle-sets")
    roots = star_roots(similar_pairs(docs, sets, words))
    ranked = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("_md5").alias("md5"))
    least = sets.groupBy("sid").agg(F.min(ranked).alias("_least"))
    rooted = least.join(roots, least["sid"] == roots["node"], "left").select(F.coalesce("root", "sid").alias("root"), "_least")
    chosen = rooted.groupBy("root").agg(F.min("_least").alias("_least"))
    return standing_rows(docs, saved(chosen, "chosen"), key)
