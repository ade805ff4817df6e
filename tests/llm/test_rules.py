import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import rules, sitebayes, textmodel

WORD = r"[^\x20\x09-\x0D]+"


def brute_counts(text):
    text = text or ""
    words = re.findall(WORD, text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = collections.Counter(grams)
    inside = {j for i, g in enumerate(grams) if times[g] > 1 for j in range(i, i + 5)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        lines += line in seen and bool(re.search(WORD, line))
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(inside)


@given(st.lists(st.text(st.sampled_from(list("ab é漢\n\t |#\x1c\x85\xa0")), max_size=60), max_size=5))
def test_base_counts(texts):
    got = rules.base_counts(pa.array(texts, pa.string()), texts)
    assert [tuple(c) for c in got.T] == [brute_counts(t) for t in texts]


def test_base_counts_of_texts_longer_than_a_block(monkeypatch):
    monkeypatch.setattr(textmodel, "BLOCK_BYTES", 64)
    texts = [None, "a b c d e " * 30, "x" * 200, "short\nshort", "é " * 50, "", "words # of one kind | " * 9]
    got = rules.base_counts(pa.array(texts, pa.string()), texts)
    assert [tuple(c) for c in got.T] == [brute_counts(t) for t in texts]


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/labels.parquet")


@pytest.fixture(scope="module")
def many_docs(spark, sf_dir):
    return spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet")


@pytest.fixture(scope="module")
def model(many_docs, labels):
    return rules.quality_model(many_docs, labels)


def test_model_on_held_out_labels(spark, many_docs, labels):
    rows = many_docs.join(labels, "doc_id").orderBy(F.xxhash64("doc_id")).select("text", "quality").collect()
    texts, y = [r.text for r in rows], np.array([r.quality for r in rows])
    cut = len(rows) * 2 // 3
    found = textmodel.fit(texts[:cut], y[:cut], float(y[:cut].mean()))
    p = 1 / (1 + np.exp(-found.logits(pa.array(texts[cut:]))))
    assert ((p >= 0.5) == y[cut:]).mean() > 0.93
    assert (p[y[cut:] == 1] >= 0.5).mean() > 0.97
    assert abs(p.mean() - y[cut:].mean()) < 0.08  # calibrated


def test_scores_do_not_depend_on_batches(model):
    texts = ["one two three", None, "", "a | b | c | d", "naïve café " * 40]
    whole = model.logits(pa.array(texts, pa.string()))
    single = [model.logits(pa.array([t], pa.string()))[0] for t in texts]
    assert np.allclose(whole, single)
    assert np.allclose(model.logits(pa.array(["x", *texts], pa.string()).slice(1)), whole)


@pytest.mark.parametrize("size", [7, 64, 1000])
def test_scores_do_not_depend_on_blocks(model, monkeypatch, size):
    texts = ["one two three four " * 20, None, "x" * 150 + " y", "a  b é漢漢 | " * 30, " " * 99 + "end", "naïve café", "漢字" * 80]
    whole, rows = model.logits(pa.array(texts, pa.string())), textmodel.features(pa.array(texts, pa.string()))
    monkeypatch.setattr(textmodel, "BLOCK_BYTES", size)
    assert np.allclose(model.logits(pa.array(texts, pa.string())), whole, atol=1e-9)
    cut = textmodel.features(pa.array(texts, pa.string()))
    table = [np.zeros((len(texts), 4 << textmodel.BITS)) for _ in range(2)]
    for t, (r, slot, value) in zip(table, (rows, cut)):
        np.add.at(t, (r, slot), value)
    assert np.allclose(*table)


def test_grams_are_of_characters():
    block = next(textmodel.blocks(pa.array(["é漢a\U0001f600b", "漢a\U0001f600"])))
    slots, inside = textmodel.gram_slots(block)
    assert inside.tolist() == [True, True, True, False, False, True, False, False]
    assert slots[1] == slots[5] and len(set(slots[:3].tolist())) == 3


def test_kept_is_the_probability_of_a_plain_sum(docs, model):
    """Scores recomputed feature by feature."""
    for r in rules.judge(docs.limit(60), model).collect():
        rows, slots, values = textmodel.features(pa.array([r.text or ""]))
        raw = model.bias + float((np.concatenate((model.words, model.pairs, model.grams)).astype(float)[slots] * values).sum())
        p = 1 / (1 + np.exp(-(model.slope * raw + model.shift)))
        assert abs(p - r.quality_probability) < 1e-6
        assert r.kept == (not r.base_failed and r.quality_probability >= 0.5)


def test_judge_keeps_rows_and_clashing_columns(odd_docs, no_docs, model):
    extra = odd_docs.withColumn("kept", F.lit("mine")).withColumn("N_WORDS", F.lit(7))
    out = rules.judge(extra, model)
    assert out.columns[: len(extra.columns)] == extra.columns and out.columns[-1] == "_kept"
    rows = out.collect()
    assert len(rows) == extra.count() and {r["kept"] for r in rows} == {"mine"}
    for r in rows:
        n, chars, symbols, lines, repeated = brute_counts(r.text)
        failed = n < 10 or 100 * repeated > 20 * n
        assert (r._n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, lines, repeated, failed)
        assert not (failed and r._kept)
    assert rules.judge(no_docs, model).count() == 0


def test_model_without_both_classes():
    found = textmodel.fit(["a b", "c d"], np.array([1, 1]))
    assert found.logits(pa.array(["x y"]))[0] > 0
    assert textmodel.fit([], np.array([])).logits(pa.array([None], pa.string())).shape == (1,)


def test_sites_shrink_to_the_corpus(spark, model, many_docs):
    out = sitebayes.site_quality(many_docs, model).collect()
    assert len(out) == many_docs.count()
    by_host = collections.defaultdict(list)
    for r in out:
        by_host[r.host].append(r.document_probability)
    mean = np.mean([r.document_probability for r in out])
    for r in out:
        own = np.mean(by_host[r.host])
        assert min(own, mean) - 0.05 <= r.host_posterior <= max(own, mean) + 0.05


def test_bad_site_lowers_its_documents(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"s{i % 40}", "en", float(rng.normal(-2 if i % 40 == 0 else 2, 1))) for i in range(4000)] + [(5000, "new", "en", 0.2), (5001, None, None, 0.2), (5002, "s0", "en", 0.2)]
    scored = spark.createDataFrame(rows, "doc_id long, host string, path string, evidence double")
    sites = sitebayes.site_sums(scored, "host", "path")
    prior = sitebayes.fit_prior(sites)
    out = {r.doc_id: r for r in sitebayes.combine(scored, sites, prior, "host", "path").collect()}
    assert len(out) == len(rows)
    assert out[5002].host_posterior < 0.5 < out[5000].host_posterior
    assert not out[5002].kept and out[5000].kept and out[5001].kept
    assert out[5000].host_posterior == pytest.approx(prior.mean, abs=1e-9)  # nothing else known of the site


def brute_posteriors(rows):
    """``host, path`` posteriors and that of the document, from ``(host, path, log-odds)`` one document at a time."""
    p = [1 / (1 + np.exp(-r[2])) for r in rows]
    n, mean = len(rows), float(np.mean(p))
    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for (h, a, _), x in zip(rows, p):
        hosts[h].append(x)
        paths[h, a].append(x)

    def spread(groups):
        return sum(((np.array(g) - np.mean(g)) ** 2).sum() for g in groups.values())

    def strength(within, between):
        return min(1e9, max(1.0, within / between)) if between > 0 else 1e9

    within_path = spread(paths) / max(1, n - len(paths))
    within_host = spread(hosts) / max(1, n - len(hosts))
    over_hosts = sum(len(g) * (np.mean(g) - mean) ** 2 for g in hosts.values())
    host_var = (over_hosts - (len(hosts) - 1) * within_host) / max(1, n - sum(len(g) ** 2 for g in hosts.values()) / n)
    over_paths = sum(len(g) * (np.mean(g) - np.mean(hosts[h])) ** 2 for (h, _), g in paths.items())
    path_var = (over_paths - (len(paths) - len(hosts)) * within_path) / max(1, n - sum(len(g) ** 2 / len(hosts[h]) for (h, _), g in paths.items()))
    k_host, k_path = strength(within_host, host_var), strength(within_path, path_var)
    out = []
    for (h, a, z), x in zip(rows, p):
        host = (k_host * mean + sum(hosts[h]) - x) / (k_host + len(hosts[h]) - 1)
        path = (k_path * host + sum(paths[h, a]) - x) / (k_path + len(paths[h, a]) - 1)
        odds = z + np.log(path / (1 - path)) - np.log(mean / (1 - mean))
        out.append((x, host, path, 1 / (1 + np.exp(-odds))))
    return out


def test_posteriors_against_plain_sums(spark, many_docs, model):
    rng = np.random.default_rng(4)
    made = [(k, f"h{k % 17}" if k % 13 else None, f"p{k % 5}", float(rng.normal((k % 17) / 8 - 1 + (k % 5) / 4, 1))) for k in range(600)]
    made += [(600, "alone", "x", -0.4), (601, "alone too", None, 1.2), (602, "h1", "rare", 3.0)]
    scored = spark.createDataFrame(made, "doc_id long, host string, path string, evidence double")
    sites = sitebayes.site_sums(scored, "host", "path")
    for rows, out in (
        ([r[1:] for r in made], sitebayes.combine(scored, sites, sitebayes.fit_prior(sites), "host", "path").orderBy("doc_id").collect()),
        (None, sitebayes.site_quality(many_docs, model).orderBy("doc_id").collect()),
    ):
        rows = rows or [(r.host, r.path, float(np.log(r.document_probability / (1 - r.document_probability)))) for r in out]
        for want, r in zip(brute_posteriors(rows), out):
            assert np.allclose(want, (r.document_probability, r.host_posterior, r.path_posterior, r.quality_posterior), atol=1e-6)
            assert r.kept == (r.quality_posterior >= 0.5)


def test_url_sites(spark):
    urls = ["http://A.example.com/fr/825?page=2", "https://u@m.x.net:80/en/25#top", "https://x.org", "https://x.org/a.html", "no url", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [tuple(r) for r in df.select(*sitebayes.url_sites(df)).collect()]
    assert got == [("a.example.com", "/fr/"), ("m.x.net", "/en/"), ("x.org", "/"), ("x.org", "/"), (None, None), (None, None)]


def test_kept_documents_with_clashing_names(odd_docs, model):
    names = ["kept", "_n", "_p", "_pp", "_host", "_path", "_host_n", "host", "path", "doc", "path_posterior"]
    extra = odd_docs
    for n in names:
        extra = extra.withColumn(n, F.lit("mine"))
    kept = sitebayes.kept_documents(extra, model)
    assert kept.columns == extra.columns
    rows = kept.collect()
    assert len(rows) == sitebayes.kept_documents(odd_docs, model).count() and all(r[n] == "mine" for r in rows for n in names)


def test_kept_documents(odd_docs, no_docs, model):
    kept = sitebayes.kept_documents(odd_docs.withColumn("evidence", F.lit("mine")), model)
    assert kept.columns == [*odd_docs.columns, "evidence"]
    assert kept.count() <= odd_docs.count()
    assert sitebayes.kept_documents(no_docs, model).count() == 0
