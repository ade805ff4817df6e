import re

import numpy as np
import pytest

import corpus_pipeline
from graphloom.llm import jaccard
from graphloom.llm.hammingtrie import merge


def brute_set(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(" ".join(found[i : i + 5]) for i in range(max(1, len(found) - 4))) if found else frozenset()


def brute_kept(rows):
    """The least key of each component of pairs with 5 x common >= 4 x union."""
    sets = [brute_set(r.text) for r in rows]
    label = np.arange(len(rows))
    for i, x in enumerate(sets):
        near = [j for j in range(i) if 5 * len(x & sets[j]) >= 4 * len(x | sets[j])]
        merge(label, np.full(len(near), i), np.array(near, np.int64))
    least = {}
    for r, c in zip(rows, label):
        least[c] = min(least.get(c, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    return sorted(least.values())


def kept(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in corpus_pipeline.near_duplicates(df.sparkSession, df, "").collect())


def edited_docs(spark, seed, groups, copies):
    """Texts of 200 words with some words changed, so that similarities lie on both sides of 0.8."""
    rng, rows = np.random.default_rng(seed), []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(200)]
        for _ in range(copies):
            words = list(base)
            for at in rng.choice(200, rng.integers(0, 9), replace=False):
                words[at] = f"x{rng.integers(1 << 40)}"
            rows.append((len(rows), " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("name", ["odd_docs", "no_docs", "docs"])
def test_stage_against_brute_jaccard(request, name):
    df = request.getfixturevalue(name)
    assert kept(df) == brute_kept(df.collect())


def test_known_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").where("doc_id IN (643, 770, 709, 944, 1, 255)")
    assert kept(docs) == [(False, 1), (False, 643), (False, 709)]


@pytest.mark.parametrize("block", [jaccard.BLOCK_SHINGLES, 3000])
def test_edited_copies_whole_and_in_chunks(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
    df = edited_docs(spark, 1, 12, 40)
    assert kept(df) == brute_kept(df.collect())


def test_window_turns_and_sizes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, jaccard.wide_fingerprint(rng.integers(0, 1 << 63, 50, dtype=np.uint64))) for i in range(30)]
    sets = spark.createDataFrame(rows, "sid long, wide binary")
    turns = jaccard.window_turns(sets).toPandas()
    assert len(turns) == 30 * 16 * 5
    for r in turns.itertuples():
        wide, k = rows[r.id][1], r.block >> 8
        ring = wide[5 * (k // 5) : 5 * (k // 5) + 5]
        ring = ring[k % 5 :] + ring[: k % 5]
        assert (r.bits & (2**64 - 1)).to_bytes(8, "big") == ring + wide[80:83] and r.block & 255 == ring[0]
        assert np.array([r.m1, r.m2]).tobytes() == wide[80:]
    sizes = {r.block: r["count"] for r in jaccard.window_sizes(sets).collect()}
    # a block's count is that of its window's segment, from whichever turn it leads
    assert sizes == turns.groupby("block").size().to_dict()


def test_windows_find_pairs_at_the_threshold():
    """Sets of similarity 0.8, 0.85 and 0.9, of 30 and 300 shingles."""
    rng = np.random.default_rng(2)
    for n in (30, 300):
        for similarity, least in ((0.8, 0.95), (0.85, 0.98), (0.9, 0.99)):
            found, tries = 0, 600
            own = round(n * (1 - similarity) / (1 + similarity))
            for _ in range(tries):
                a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
                b = np.concatenate((a[own:], rng.integers(0, 1 << 63, own, dtype=np.uint64)))
                x, y = (np.frombuffer(jaccard.wide_fingerprint(v), np.uint8) for v in (a, b))
                apart = np.bitwise_count(x ^ y).astype(int)
                found += (apart[:80].reshape(16, 5).sum(axis=1) <= 4).any() and apart[80:].sum() <= jaccard.MOST_MARK_BITS
            assert found >= least * tries, (n, similarity, found)


def test_a_group_of_near_copies_gives_few_candidate_links(spark):
    docs = edited_docs(spark, 7, 1, 400)
    one = jaccard.set_table(docs, "doc_id", 5).select("sid", "wide").dropDuplicates(["sid"])
    ties = jaccard.trie_links(jaccard.window_turns(one), jaccard.window_sizes(one), jaccard.WINDOW, jaccard.WINDOW_ERRORS, jaccard.MOST_MARK_BITS)
    assert len({frozenset(r) for r in ties.collect()}) < 4 * one.count()
