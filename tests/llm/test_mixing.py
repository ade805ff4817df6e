import collections
import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from graphloom.llm import mixing, ranks


def brute(rows, weights=(5, 2, 1), share=1.5, packet=128):
    rows = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in rows]
    sizes = collections.Counter()
    for _, n, s in rows:
        sizes[s] += n
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in capped]
        level = (total - sum(2 * sizes[s] for s in capped)) / (sum(weight[s] for s in rest) or 1)
        over = {s for s in rest if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    target = {s: 2 * sizes[s] if s in capped else level * weight[s] for s in names}
    out, stream = [], []
    for k, s in enumerate(names):
        key = lambda r: hashlib.md5(f"{f'null {r[1]}' if r[0] is None else r[0]}:mix".encode()).hexdigest()
        before = 0
        for o, (i, n, _) in enumerate(sorted((r for r in rows if r[2] == s), key=lambda r: (key(r), r[0] is not None, r[0], r[1]))):
            for p in (0, 1):
                for at in range(0, n, packet):
                    words = min(packet, n - at)
                    stream.append(((before + p * sizes[s] + at + words) / target[s], k, p, o, at, words, len(out)))
            out.append([i, n, sizes[s], round(target[s], 6), 0])
            before += n
    left = math.floor(total)
    for *_, words, at in sorted(stream):
        out[at][4] += min(words, left)
        left -= min(words, left)
    return sorted(map(tuple, out), key=str)


def mixed(df, **options):
    got = mixing.words_taken(mixing.fair_queue(df, **options)).select("doc_id", "size", "source_size", "target", "taken").collect()
    return sorted(((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in got), key=str)


@pytest.mark.parametrize("name", ["odd_docs", "no_docs", "docs"])
def test_agrees_with_brute_force(request, name):
    df = request.getfixturevalue(name)
    want = brute([(r.doc_id, r.text, r.source) for r in df.collect()])
    assert mixed(df) == want
    assert mixed(df.repartition(3)) == want


@pytest.mark.parametrize("options", [{"weights": (1, 9)}, {"share": 0.7}, {"packet": 16}, {"weights": (3, 1, 2), "share": 1.1}])
def test_weights_and_budget_move_the_cut(docs, options):
    want = brute([(r.doc_id, r.text, r.source) for r in docs.collect()], **options)
    assert mixed(docs, **options) == want
    assert sum(r[4] for r in want) == math.floor(options.get("share", 1.5) * sum(r[1] for r in want))
    if "packet" not in options:
        assert [r[4] for r in want] != [r[4] for r in mixed(docs)]


def test_stream_is_sorted_by_finish_time_and_cut_once(docs):
    stream = mixing.fair_queue(docs)
    rows = sorted((r for r in stream.collect() if r["words"]), key=lambda r: r["part"])
    keys = [tuple(r[c] for c in mixing.ORDER) for r in rows]
    assert keys == sorted(keys)  # as stored, part after part
    assert len({r["part"] for r in rows}) > 1
    taken = [r["taken"] / r["words"] for r in rows]
    assert taken == sorted(taken, reverse=True) and sum(0 < t < 1 for t in taken) <= 1


def test_sources_come_near_their_targets(docs):
    for r in mixing.fair_queue(docs).groupBy("source", "source_size", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r["taken"] - r["target"]) <= 2 * mixing.PACKET and r["taken"] <= 2 * r["source_size"]


def test_documents_keep_their_columns_and_repeat(docs):
    extra = docs.withColumn("size", F.lit("mine")).withColumn("taken", F.lit(1)).withColumn("_copies", F.lit("c")).withColumn("_copy", F.lit("d")).withColumn("_own", F.lit(2))
    out = mixing.mixed_documents(extra)
    assert out.columns == extra.columns
    assert out.select("_copies", "_copy", "size").distinct().collect() == [("c", "d", "mine")]
    times = collections.Counter(r.doc_id for r in out.select("doc_id").collect())
    assert set(times.values()) <= {1, 2} and 2 in times.values()


def test_repeated_rows_take_what_the_mix_takes(spark):
    rows = [(1, "a b c d e f g h i j", "s")] * 10 + [(k, "a b c d e f g h i j", "t") for k in range(2, 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = mixing.fair_queue(df).where("source = 's'").agg(F.sum("taken")).first()[0]
    assert abs(10 * mixing.mixed_documents(df).where("source = 's'").count() - words) <= 50


def test_running_sums_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_PER_BUCKET", 7)
    df = spark.range(500).withColumn("k", F.col("id") % 2).withColumn("p", ranks.hash_position(F.col("id").cast("string")))
    got = ranks.running_sums(df, ["k"], "p", [F.col("id")], {"r": F.lit(1), "s": F.col("id")}, 500).collect()
    for k in (0, 1):
        rows = sorted((r for r in got if r["k"] == k), key=lambda r: (r["p"], r["id"]))
        assert [r["r"] for r in rows] == list(range(250))
        assert [r["s"] for r in rows] == [sum(x["id"] for x in rows[:i]) for i in range(250)]
