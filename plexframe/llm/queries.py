"""The queries opN_<name>, each applying one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plexframe.llm import chat, jaccard, language, media, mixing, neighbours, packing, pii, reputation, secrets


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_chat_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(table(spark, sf_dir, "conversations"))


def op8_media_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation.judge(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")).drop("url")


def op10_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", language.held_out().alias("held_out"))
    model = language.train(docs.where("NOT held_out"))
    return language.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op1_hash_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op2_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "text_redacted")


def op5_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(rows, rows.where("vec_id % 20 = 0"))


def op6_secrets_dfa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hash_mix": op1_hash_mix,
    "op2_best_fit_pack": op2_best_fit_pack,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_pii_anchors": op4_pii_anchors,
    "op5_kmeans_tree": op5_kmeans_tree,
    "op6_secrets_dfa": op6_secrets_dfa,
    "op7_chat_linking": op7_chat_linking,
    "op8_media_sniff": op8_media_sniff,
    "op9_host_reputation": op9_host_reputation,
    "op10_language_ppm": op10_language_ppm,
}

SQL: dict[str, str] = {
    "op7_chat_linking": chat.ORACLE,
    "op9_host_reputation": reputation.oracle(),
}
