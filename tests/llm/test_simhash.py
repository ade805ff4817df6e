import re

import numpy as np
import pytest
import xxhash

from graphloom.llm import simhash
from graphloom.operators.components import star_roots
from graphloom.llm.hammingtrie import forest, merge, prefix_budgets


def brute_fingerprint(text, words=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not found:
        return 0
    grams = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or [" ".join(found)]
    hashes = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(hashes))


def brute_classes(fps, errors=4):
    label = np.arange(len(fps))
    for i, x in enumerate(fps):
        near = np.flatnonzero(np.bitwise_count(fps ^ x) <= errors)
        merge(label, np.full(len(near), i), near)
    return label


def turned_classes(fps, errors=4):
    label = np.arange(len(fps))
    for r in range(5):
        turned = fps if r == 0 else (fps << np.uint64(13 * r)) | (fps >> np.uint64(64 - 13 * r))
        order = np.argsort(turned, kind="stable")
        block = (turned[order] >> np.uint64(52 if r == 4 else 51)).astype(np.int64)
        starts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(fps)]))
        found = forest(turned[order], starts, errors)
        moved = np.flatnonzero(found != np.arange(len(fps)))
        merge(label, order[found[moved]], order[moved])
    return label


@pytest.mark.parametrize("errors", [0, 1, 2, 3, 4])
@pytest.mark.parametrize(("clusters", "size", "flips"), [(40, 10, 3), (1, 400, 6), (5, 60, 5)])
def test_trie_join_finds_all_links(errors, clusters, size, flips):
    rng = np.random.default_rng(clusters * 100 + errors)
    parts = [rng.integers(0, 2**64, 300, dtype=np.uint64)]
    for _ in range(clusters):
        near = np.full(size, rng.integers(0, 2**64, dtype=np.uint64))
        for _ in range(flips):
            near ^= np.uint64(1) << rng.integers(0, 64, size, dtype=np.uint64)
        parts.append(near)
    fps = np.unique(np.concatenate(parts))
    assert (turned_classes(fps, errors) == brute_classes(fps, errors)).all()


def test_budgets():
    got = prefix_budgets(4)
    assert got[12] == 0 and got[13] == 1 and got[26] == 2 and got[64] == 4


@pytest.mark.parametrize("text", [None, "", " \n", "one", "A B c D", "a b c d e", "É Ü ß x y z", "w " * 5000 + "end"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("name", ["odd_docs", "no_docs", "docs"])
def test_components(request, name):
    df = request.getfixturevalue(name)
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in df.collect()]
    label = brute_classes(np.array([f for _, f in rows], np.uint64))
    least = {}
    for (i, _), c in zip(rows, label):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted(((i, f"{f:016x}", least.get(c)) for (i, f), c in zip(rows, label)), key=str)
    got = simhash.simhash_components(df).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_hot_blocks_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 16)
    monkeypatch.setattr(simhash, "BATCH_ROWS", 64)
    rng = np.random.default_rng(5)
    fps = np.full(200, 0x0123456789ABCDEF, np.uint64)
    for _ in range(5):
        fps ^= np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)
    fps = np.unique(fps)
    pairs = simhash.near_pairs(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")).collect()
    at = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    label = np.arange(len(fps))
    merge(label, np.array([at[r.a] for r in pairs]), np.array([at[r.b] for r in pairs]))
    assert (label == brute_classes(fps)).all()


def test_one_of_each(odd_docs, docs):
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id is None, r.doc_id) for r in kept.select("doc_id").collect())
    classes = {r.component_id for r in simhash.simhash_components(odd_docs).collect() if r.component_id is not None}
    assert {i for none, i in ids if not none} == classes
    assert len(ids) == len(classes) + 1  # and the text that no row with an id has


def test_star_roots_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    roots = {r.node: r.root for r in star_roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 160)}}
