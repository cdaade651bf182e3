"""The registered queries: each operator over the whole of its table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscape.llm import (
    common, embeddings, fertility, language, mixing, packing, pii, prefix_trie, sharding, simhash, token_ids, url_filter, vector_codes, warc,
)
from lendscape.session import Workspace


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, common.table(spark, sf_dir, "documents"), Workspace(spark, "simhash"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(spark, common.table(spark, sf_dir, "documents"), Workspace(spark, "pii"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, common.table(spark, sf_dir, "pages"), Workspace(spark, "warc"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.round_trip(spark, common.table(spark, sf_dir, "documents"), Workspace(spark, "token-ids"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(spark, common.table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(spark, common.table(spark, sf_dir, "documents"), Workspace(spark, "mixing"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op7_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fertility.judge(spark, common.table(spark, sf_dir, "documents"), Workspace(spark, "fertility"))
    return rows.select("doc_id", *fertility.COUNTS, "base_failed", "kept", *fertility.MEASURES)


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark, common.table(spark, sf_dir, "embeddings"), Workspace(spark, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, common.table(spark, sf_dir, "documents"), Workspace(spark, "packing"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(spark, common.table(spark, sf_dir, "documents"), ws=Workspace(spark, "sharding"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_trie(spark, common.table(spark, sf_dir, "conversations"), Workspace(spark, "prefix-trie"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels' ids are taken as those of the pages."""
    pages, labels = common.table(spark, sf_dir, "pages"), common.table(spark, sf_dir, "labels")
    judged = url_filter.judge(spark, pages, url_filter.outcomes(labels), Workspace(spark, "url-filter"))
    return judged.withColumn("low", F.round("low", 6))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(spark, common.table(spark, sf_dir, "embeddings"), Workspace(spark, "vector-codes"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_pii, op3_warc, op4_token_ids, op5_language, op6_mixing, op7_fertility, op8_embeddings, op9_packing,
        op10_sharding, op11_prefix_trie, op12_url_filter, op13_vector_codes,
    )
}
