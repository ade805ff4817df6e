"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import htmltext, mediacopies, mixing, packing, renders, rules, sharding, simhash, sitebayes, tokencount, warc
from .storage import new_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = renders.media_from_vectors(table(spark, sf_dir, "embeddings"))
    return mediacopies.copy_classes(media)


def op2_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.packed_documents(table(spark, sf_dir, "documents"), digest=True)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.words_taken(mixing.fair_queue(table(spark, sf_dir, "documents")))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op4_simhash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = rules.quality_model(docs, table(spark, sf_dir, "labels"))
    judged = rules.judge(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sitebayes.site_quality(docs, rules.quality_model(docs, table(spark, sf_dir, "labels")))


def op8_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"))
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), new_dir(spark, "flat-tokens"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_media_copies, op2_pack_windows, op3_mix_sources, op4_simhash_links, op5_warc_roundtrip, op6_quality_rules, op7_site_quality, op8_shard_documents, op9_token_counts, op10_main_text)
}
