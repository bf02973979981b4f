"""The dealt operators applied to the given tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, embed_dedup, exact_repeats, lexical, line_dedup, orchard, packing, pii, quality, simhash, token_files, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality.judge(table(spark, sf_dir, "documents"), trusted)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.round_trip(table(spark, sf_dir, "documents"))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[pii.count_of(k).alias(f"n_{k}") for k in pii.BASE],
                        F.sha2(pii.listed(pii.base_only()).cast("binary"), 256).alias("base_sha256"),
                        pii.listed(F.col("spans")).alias("spans"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.token_path(spark)
    manifest = token_files.write_tokens(table(spark, sf_dir, "documents"), path)
    return token_files.digests(token_files.read_tokens(manifest, path))


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_repeats.digests(exact_repeats.remove_repeats(table(spark, sf_dir, "documents")))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, _ = orchard.cluster(table(spark, sf_dir, "embeddings"))
    return orchard.with_inertia(assigned)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_chat_formatting, op2_simhash_near_dedup, op3_quality_rules, op4_byte_bpe, op5_embedding_near_dedup,
    op6_line_dedup, op7_packing, op8_pii, op9_toxicity, op10_token_files,
    op11_suffix_array_dedup, op12_centroid_clustering, op13_ranked_search)}

SQL: dict[str, str] = {"op1_chat_formatting": chat.SQL, "op12_centroid_clustering": orchard.SQL,
                       "op13_ranked_search": lexical.SQL}
