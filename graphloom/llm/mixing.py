"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ROWS_PER_BUCKET, hash_position, running_sums
from .storage import free_name, saved

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
PACKET = 128
ORDER = ("virtual_finish", "source_rank", "pass", "ordinal", "packet")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """Targets of the rows ``(source, source_size)``: one row for each source.

    Sources in code-point order, null last, take ``weights`` in turn and split
    ``share`` of all sizes.  A target stops at ``repeats`` times its source's
    size and the excess goes to the others by weight.  That is a water level:
    with sources ordered by capacity for each unit of weight, the level is set
    by the first source that it does not overflow.  The windows here run over
    one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("_rank", F.row_number().over(by_name).cast("long"))
    ranked = ranked.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * repeats)
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    everything = Window.partitionBy()
    ranked = ranked.withColumn("_full", F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.withColumn("_open", F.sum("_weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    ranked = ranked.withColumn("_at", F.row_number().over(by_ratio))
    ranked = ranked.withColumn("_level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.col("_full")) / F.col("_open"))
    fits = F.when(F.col("_level") <= F.col("_cap") / F.col("_weight"), F.struct("_at", "_level"))
    ranked = ranked.withColumn("_level", F.min(fits).over(everything)["_level"])
    target = F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_level") * F.col("_weight"), F.col("_cap").cast("double")))
    return ranked.select("source", F.col("_rank").alias("source_rank"), "source_size", target.alias("target"))


def fair_queue(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    repeats: int = 2,
    seed: str = "mix",
    key: str = "doc_id",
    packet: int = PACKET,
) -> DataFrame:
    """The mixed stream: the packets of each pass over each document, in global order of virtual finish time.

    ``docs`` has ``key``, ``text`` and ``source``; other columns are left out.
    A document's size is its number of words (null text: 0).  Each source is
    shuffled by the MD5 of its keys and served pass after pass, in packets of
    at most ``packet`` words of a document.  A packet finishes at (words of its
    source up to its end) / (its source's target).  All packets are
    range-sorted by finish time and the stream is truncated where its words
    reach the total budget, ``share`` times all sizes.  So a source's words
    differ from its target by little more than a packet.

    Columns: ``key, source, size, source_size, target, source_rank, ordinal``
    (place in the shuffled source from 0), ``pass, packet, words,
    virtual_finish, part`` (of the sorted stream) and ``taken``, the packet's
    words before the cut.  Without
    words a document has one row, with null in ``pass`` to ``virtual_finish``
    and ``taken`` 0.  An empty table gives no rows; equal rows are served one
    by one; null keys are shuffled by size; null sources are one source, the
    last.
    """
    narrow = saved(docs.select(F.col(key).alias("_key"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "mix-sizes")
    totals = narrow.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    rows, budget = int(totals[0]), int(totals[1] * share)
    targets = source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats)
    digest = F.concat(F.coalesce(F.col("_key").cast("string"), F.concat(F.lit("null "), F.col("size").cast("string"))), F.lit(f":{seed}"))
    shuffled = (
        narrow.join(targets.withColumnRenamed("source", "_name"), F.col("source").eqNullSafe(F.col("_name")))
        .drop("_name")
        .withColumn("_md5", F.md5(digest.cast("binary")))
        .withColumn("_position", hash_position(digest))
    )
    queued = running_sums(shuffled, ["source_rank"], "_position", [F.col("_md5"), F.col("_key"), F.col("size")], {"_words": F.col("size"), "ordinal": F.lit(1)}, rows)
    passes = F.sequence(F.lit(1), F.when(F.col("size") > 0, F.lit(repeats)))
    served = queued.withColumn("pass", F.explode_outer(passes))
    served = served.withColumn("packet", F.explode_outer(F.when(F.col("pass").isNotNull(), F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / packet)))))
    first = F.col("packet") * packet
    served = served.withColumn("words", F.when(F.col("packet").isNotNull(), F.least(F.lit(packet).cast("long"), F.col("size") - first)))
    served = served.withColumn("virtual_finish", F.try_divide(F.col("_words") + (F.col("pass") - 1) * F.col("source_size") + first + F.col("words"), F.col("target")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = [F.col("_key").alias(key), "source", "size", "source_size", "target", "source_rank", "ordinal", "pass", "packet", "words", "virtual_finish"]
    stream = served.select(*kept).repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER)
    stream = saved(stream.withColumn("part", F.spark_partition_id()), "mix-stream")
    at, rest = _cut(stream, budget)
    now = F.struct(*ORDER)
    taken = F.coalesce(F.col("words"), F.lit(0)) if at is None else F.when(F.col("words").isNull() | (now > at), F.lit(0)).when(now < at, F.col("words")).otherwise(F.lit(rest))
    return stream.withColumn("taken", taken.cast("long"))


def _cut(stream: DataFrame, budget: int) -> tuple[Column | None, int]:
    """Place in the order of the packet in which the stream's words reach ``budget``, and how many of its words come before.

    Words are added up for each of the sorted stream's parts, then for time
    slices of the part that holds the cut, then packet by packet in one slice:
    no task orders more than parts, slices, or the packets of a slice.
    """
    kinds = {f.name: f.dataType for f in stream.schema}
    bounds = [F.sum("words").alias("words"), F.count("words").alias("n"), F.min("virtual_finish").alias("lo"), F.max("virtual_finish").alias("hi")]
    stream = stream.where("words is not null")
    part = _crossing(stream.groupBy("part").agg(*bounds), ["part"], budget)
    if part is None:
        return None, 0
    budget -= part["_before"]
    slices = max(1, part["n"] // ROWS_PER_BUCKET)
    width = (part["hi"] - part["lo"]) / slices
    place = F.floor((F.col("virtual_finish") - F.lit(part["lo"])) / F.lit(width)) if width else F.lit(0)
    inside = stream.where((F.col("part") == part["part"]) & F.col("virtual_finish").between(part["lo"], part["hi"])).withColumn("_slice", place)
    slice_ = _crossing(inside.groupBy("_slice").agg(F.sum("words").alias("words")), ["_slice"], budget)
    found = _crossing(inside.where(F.col("_slice") == slice_["_slice"]), list(ORDER), budget - slice_["_before"])
    at = F.struct(*(F.lit(found[c]).cast(kinds[c]).alias(c) for c in ORDER))
    return at, budget - slice_["_before"] - found["_before"]


def _crossing(sums: DataFrame, order: list[str], budget: int):
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = sums.withColumn("_before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    return run.where((F.col("_before") <= budget) & (F.col("_before") + F.col("words") > budget)).first()


def words_taken(mix: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each document of :func:`fair_queue`'s stream, its packets added up."""
    one = [F.first(c).alias(c) for c in (key, "source", "size", "source_size", "target")]
    return mix.groupBy("source_rank", "ordinal").agg(*one, F.sum("taken").alias("taken")).drop("source_rank", "ordinal")


def mixed_documents(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``docs`` as often as the mix takes them: a document in service at the cut stays whole.

    Keeps the columns of ``docs``, whatever their names.  Rows with one key
    (null keys are one) can't be told apart: each comes as often as the mix
    takes them on average, rounded.  Documents without words (null or empty
    texts) are not taken; an empty table gives no rows.
    """
    taken = words_taken(fair_queue(docs, key=key, **options), key)
    copies, copy, own = (free_name(docs, n) for n in ("_copies", "_copy", "_own"))
    times = F.when(F.count("*") == 1, F.ceil(F.try_divide(F.sum("taken"), F.sum("size")))).otherwise(F.round(F.try_divide(F.sum("taken"), F.sum("size"))))
    counted = taken.groupBy(F.col(key).alias(own)).agg(times.cast("int").alias(copies)).where(F.col(copies) > 0)
    kept = docs.join(counted, docs[key].eqNullSafe(counted[own]))
    return kept.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*(docs[c] for c in docs.columns))
