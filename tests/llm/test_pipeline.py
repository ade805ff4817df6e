import collections

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import mixing, rules
from graphloom.llm.storage import saved
from graphloom.llm.tokens import encoder, vocabulary_paths
from tests.llm.test_jaccard import brute_kept


@pytest.fixture(scope="module")
def stages(spark, sf_dir, odd_docs):
    """What each stage gets and returns, over the test documents and odd ones."""
    given, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    given = given.unionByName(odd_docs.selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars"))
    for name, stage in corpus_pipeline.STAGES:
        made = saved(stage(spark, given, sf_dir), "test-stage")
        out.append((given, made))
        given = made
    return out


def rows(df):
    return df.collect()


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "near duplicates", "mixing", "packing"]
    for given, made in stages[:-1]:
        assert made.columns == given.columns


def test_rules_drop_what_they_reject(spark, sf_dir, stages):
    given, made = stages[0]
    model = rules.quality_model(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = [r for r in rules.judge(given, model).collect() if r.kept]
    assert sorted(str(r.doc_id) for r in want) == sorted(str(r.doc_id) for r in rows(made))


def test_classifier_keeps_clean_documents(spark, sf_dir, stages):
    given, made = stages[1]
    clean = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()}
    before, after = ({r.doc_id for r in rows(df)} for df in (given, made))
    assert after <= before and len(clean & after) >= 0.98 * len(clean & before)


def test_one_document_of_each_group(stages):
    given, made = stages[2]
    assert brute_kept(rows(given)) == sorted((r.doc_id is None, r.doc_id or 0) for r in rows(made))


def test_mix_repeats_documents(stages):
    given, made = stages[3]
    taken = mixing.words_taken(mixing.fair_queue(given)).where("taken > 0").collect()
    want = {r.doc_id: -(-r.taken // r.size) for r in taken}
    assert collections.Counter(r.doc_id for r in rows(made)) == collections.Counter(want)


def test_packing_covers_all_tokens(stages):
    given, made = stages[4]
    encode = encoder(vocabulary_paths()).encode
    total = sum(len(encode(r.text or "")) // 4 + 1 for r in rows(given))
    pieces = rows(made)
    assert sum(r.length for r in pieces) == total
    loads = collections.Counter()
    for r in pieces:
        loads[r.sequence_id] += r.length
    assert max(loads.values()) <= 2048


NAMES = ["_copies", "_copy", "_own", "kept", "evidence", "_n", "_host", "size", "shard", "fingerprint", "_key", "_position", "words", "n_words", "base_failed", "component_id"]


@pytest.mark.parametrize("at", range(5))
def test_stages_with_clashing_names_and_without_rows(spark, sf_dir, odd_docs, no_docs, at):
    name, stage = corpus_pipeline.STAGES[at]
    plain = odd_docs.where("text is null or length(text) < 5000")
    named = plain.select("*", *(F.lit(k).alias(n) for k, n in enumerate(NAMES)))
    made = stage(spark, named, sf_dir)
    assert at == 4 or made.columns == named.columns
    ids = lambda df: sorted(str(r.doc_id) for r in df.select("doc_id").collect())
    assert ids(made) == ids(stage(spark, plain, sf_dir))
    if at < 4:
        assert all([r[n] for n in NAMES] == list(range(len(NAMES))) for r in made.collect())
    assert stage(spark, no_docs, sf_dir).collect() == []


def test_kept_rows_come_in_small_groups(spark, sf_dir, tmp_path):
    big = spark.range(0, 5_000_000, 1, 1).selectExpr("id", "xxhash64(id) AS x")
    path = saved(big, "groups")._kept_path.removeprefix("file:")
    corpus_pipeline.quality_classifier(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    big.write.parquet(str(tmp_path / "stage"))  # as a caller would keep a stage's rows
    for folder in (path, str(tmp_path / "stage")):
        found = [f.metadata for f in map(pq.ParquetFile, pq.ParquetDataset(folder).files)]
        assert max(m.row_group(k).total_byte_size for m in found for k in range(m.num_row_groups)) < 40 << 20


def test_stages_decode_few_rows_at_once(spark, sf_dir, no_docs):
    name = "spark.sql.parquet.columnarReaderBatchSize"
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(name)
            stage(spark, no_docs, sf_dir)
            assert int(spark.conf.get(name)) == corpus_pipeline.BATCH_ROWS
        spark.conf.set(name, "99")
        corpus_pipeline.quality_rules(spark, no_docs, sf_dir)
        assert spark.conf.get(name) == "99"
    finally:
        spark.conf.unset(name)
