"""The corpus pipeline: two quality filters, near-duplicate removal, mixing and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import jaccard, mixing, packing, rules, sitebayes
from graphloom.llm.storage import GROUP_BYTES, saved
from graphloom.llm.textmodel import TextModel

#: Mixing shuffles by hash order and packing cuts by token ids: SQL can't express them.
ORACLE_SQL = None


#: Rows that a task decodes from Parquet at once: of whole texts, Spark's 4,096 take some 30 MB in each task, and more where texts are long.
BATCH_ROWS = 256


def _small_reads(spark: SparkSession) -> None:
    """Readers decode few rows at once, and whoever keeps a stage's rows as Parquet writes groups that the next stage's tasks can all hold; a set size stays."""
    known = spark.conf.getAll
    for name, size in (("parquet.block.size", GROUP_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", BATCH_ROWS)):
        if name not in known:
            spark.conf.set(name, str(size))


def _model(spark: SparkSession, sf_dir: str) -> TextModel:
    """Fitted on the labelled documents as they came, junk included."""
    return rules.quality_model(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the n-gram model."""
    _small_reads(spark)
    judged = rules.judge(docs, _model(spark, sf_dir))
    return judged.where(judged[judged.columns[-1]]).select(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text and site make good quality likely."""
    _small_reads(spark)
    return sitebayes.kept_documents(docs, _model(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that pairs of similarity 0.8 or more link, over shingles of five words."""
    _small_reads(spark)
    return jaccard.one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    _small_reads(spark)
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in windows."""
    _small_reads(spark)
    return packing.packed_documents(docs, digest=True)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("mixing", mixed_sources),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is kept as Parquet for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
