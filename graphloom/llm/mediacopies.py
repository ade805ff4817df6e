"""Cropped and edited copies in a column of images."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.components import star_roots

from .images import BITS, consensus, decode, descriptors, mutual_matches
from .storage import saved

ENTRY_BYTES = 6
#: Of the twelve bytes of the most telling tests, four halves and the halves that they leave; any other two share three bytes.
TABLE_BYTES = [sorted({(q + t) % 11 for q in (1, 3, 4, 5, 9)} | {11}) for t in range(4)] + [sorted((q + t) % 11 for q in (0, 2, 6, 7, 8, 10)) for t in range(4)]
TABLES_AT_ONCE = 4
LEAST_AGREEMENT = 4
LEAST_SHARED = 2


def local_features(media: DataFrame, key: str = "media_id", image: str = "image") -> DataFrame:
    """A row for each image: ``id, digest, readable, places, bits``.

    ``places`` has each corner's x, y, scale and angle as 32-bit floats,
    ``bits`` its 256 tests; both are empty where an image can't be read (not
    ``readable``) or shows no corners, and null, like the SHA-256 ``digest``,
    where it is null.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                rows = []
                for data in batch.column(1).to_pylist():
                    picture = decode(data)
                    where, bits = descriptors(picture) if picture is not None else (np.zeros((0, 4)), np.zeros((0, BITS // 8), np.uint8))
                    rows.append((None, None, None, None) if data is None else (hashlib.sha256(data).digest(), picture is not None, where.astype("<f4").tobytes(), bits.tobytes()))
                digest, readable, places, tests = zip(*rows)
                arrays = [batch.column(0).cast(pa.int64()), pa.array(digest, pa.binary()), pa.array(readable, pa.bool_()), pa.array(places, pa.binary()), pa.array(tests, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "digest", "readable", "places", "bits"])

    return media.select(key, image).mapInArrow(read, "id long, digest binary, readable boolean, places binary, bits binary")


def table_entries(features: DataFrame, tables: range) -> DataFrame:
    """``entry, id``: 48 bits of each corner as its entry in each of the Hamming ``tables``.

    Two descriptors that differ in few bits share an entry of some table, and
    a copy shares many corners, so it is found at larger distances as well.
    Tests that are alike or have one answer mostly would make unlike images
    share entries, so the entries hold only the most telling ones.
    """
    places = np.array([TABLE_BYTES[t] for t in tables])
    marks = np.array(tables, np.uint8)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tests = np.frombuffer(bits, np.uint8).reshape(-1, BITS // 8)[:, places]
                entries = np.zeros((*tests.shape[:2], 8), np.uint8)
                entries[:, :, 0] = marks
                entries[:, :, 1 : 1 + ENTRY_BYTES] = tests
                found = np.unique(entries.view(">i8").astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), own, np.int64))], names=["entry", "id"])

    return features.select("id", "bits").where("length(bits) > 0").mapInArrow(split, "entry long, id long")


def entry_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of whole runs of equal entries, the first column, from batches in its order."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if not len(columns[0]):
            continue
        # all but the last entry are complete
        last = int(np.searchsorted(columns[0], columns[0][-1], "left"))
        if last or (held and held[-1][0][-1] != columns[0][0]):
            yield tuple(np.concatenate(c) for c in zip(*held, [c[:last] for c in columns]))
            held = []
        held.append([c[last:] for c in columns])
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def shared_entries(entries: DataFrame) -> DataFrame:
    """The rows ``entry, id`` of entries that several images have; most have one, and go."""
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entry, own in entry_groups(batches):
            same = entry[1:] == entry[:-1]
            kept = np.concatenate(([False], same)) | np.concatenate((same, [False])) if len(entry) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(entry[kept]), pa.array(own[kept])], names=["entry", "id"])

    return entries.repartition(parts, "entry").sortWithinPartitions("entry").mapInArrow(several, "entry long, id long")


def voted(pairs: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """Pairs ``a < b`` that ``least`` entries or more have in common."""
    return pairs.where("a < b").groupBy("a", "b").count().where(F.col("count") >= least).select("a", "b")


def centre_pairs(members: DataFrame, centre) -> DataFrame:
    """Each image of an entry with the entry's ``centre`` (an aggregate of ``id``)."""
    tied = members.join(members.groupBy("entry").agg(centre.alias("centre")), "entry")
    return voted(tied.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")))


def cross_pairs(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of images that share entries and are not in one class yet."""
    homes = members.join(roots, members["id"] == roots["node"], "left").select("entry", "id", F.coalesce("root", "id").alias("home"))
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entry, own, home in entry_groups(batches):
            # the k-th next image of the same entry, until no entry reaches so far
            step, left = 1, np.arange(len(entry))
            while len(left):
                left = left[left + step < len(entry)]
                left = left[entry[left] == entry[left + step]]
                apart = left[home[left] != home[left + step]]
                for at in range(0, len(apart), 1 << 16):
                    x, y = own[apart[at : at + (1 << 16)]], own[apart[at : at + (1 << 16)] + step]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])
                step += 1

    return voted(homes.repartition(parts, "entry").sortWithinPartitions("entry").mapInArrow(pair, "a long, b long"))


def agreeing(pairs: DataFrame, features: DataFrame, least: int = LEAST_AGREEMENT) -> DataFrame:
    """The pairs ``a, b`` of which ``least`` mutually nearest corners agree on one similarity mapping."""
    left = features.select(F.col("id").alias("a"), F.col("places").alias("pa"), F.col("bits").alias("ba"))
    right = features.select(F.col("id").alias("b"), F.col("places").alias("pb"), F.col("bits").alias("bb"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for r in batch.to_pylist():
                p, q = (np.frombuffer(r[c], "<f4").reshape(-1, 4).astype(float) for c in ("pa", "pb"))
                x, y = (np.frombuffer(r[c], np.uint8).reshape(-1, BITS // 8) for c in ("ba", "bb"))
                m = mutual_matches(x, y)
                if len(m) >= least and consensus(p[m[:, 0]], q[m[:, 1]]) >= least:
                    kept.append((r["a"], r["b"]))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept)], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "pb", "ba", "bb").mapInArrow(verify, "a long, b long").distinct()


def copy_classes(media: DataFrame, key: str = "media_id", image: str = "image", least: int = LEAST_AGREEMENT) -> DataFrame:
    """``key, class_id, class_size, readable`` of every image.

    Equal bytes are one image before anything is joined, so exact copies never
    meet.  Two images that share ``LEAST_SHARED`` table entries are candidates;
    they are linked when ``least`` corners at different places agree on one
    mapping.  Each entry's images are tested against its least and then its
    greatest image; then every candidate pair whose images are not in one class
    yet is tested, so no link between classes is lost and a family of copies
    costs about as much as it has members.  ``class_id`` is the least key that
    can be reached and ``class_size`` the rows of the class.  Unreadable images
    are classes of equal bytes.  Null images (``readable`` null) and null keys
    stand alone, the class of a null key is null.  Images with one key and
    different bytes are compared by all of them, and share the key's class.
    Images of any size are read whole; an empty table gives no rows.
    """
    features = saved(local_features(media, key, image), "features")
    known = features.where("id is not null and digest is not null")
    unique = saved(known.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("copies")), "media")
    # of images with one least key the one with the least digest stands for the key
    first = unique.groupBy("least").agg(F.min("digest").alias("chosen"))
    bits = known.select("id", "digest", "bits").join(first, (F.col("id") == F.col("least")) & (F.col("digest") == F.col("chosen")), "left_semi")
    bits = bits.dropDuplicates(["id", "digest"])
    passes = []
    for first_table in range(0, len(TABLE_BYTES), TABLES_AT_ONCE):
        passes.append(saved(shared_entries(table_entries(bits, range(first_table, first_table + TABLES_AT_ONCE))), "entries"))
        media.sparkSession.sparkContext._jvm.System.gc()  # lets go of the shuffle files, which are most of what a pass needs
    members = functools.reduce(DataFrame.unionByName, passes)
    links = saved(agreeing(centre_pairs(members, F.min("id")), known, least), "media-links")
    for pairs in (lambda roots: centre_pairs(members, F.max("id")), lambda roots: cross_pairs(members, roots)):
        roots = star_roots(links)
        tested = pairs(roots)
        homes = roots.select(F.col("node").alias("n"), "root")
        apart = tested.join(homes, tested["a"] == homes["n"], "left").select("a", "b", F.coalesce("root", "a").alias("ra"))
        apart = apart.join(homes, apart["b"] == homes["n"], "left").where(F.col("ra") != F.coalesce("root", "b")).select("a", "b")
        links = saved(links.unionByName(agreeing(apart, known, least)), "media-links")
    roots = star_roots(links)
    homes = unique.join(roots, F.col("least") == F.col("node"), "left").select(F.col("digest").alias("_of"), F.coalesce("root", "least").alias("class_id"), "copies")
    sizes = homes.groupBy(F.col("class_id").alias("_class")).agg(F.sum("copies").alias("class_size"))
    homes = homes.drop("copies").join(sizes, F.col("class_id") == F.col("_class")).drop("_class")
    rows = features.select("id", "readable", F.when(F.col("id").isNotNull(), F.col("digest")).alias("digest"))
    out = rows.join(homes, F.col("digest") == F.col("_of"), "left")
    return out.select(F.col("id").alias(key), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), "readable")
