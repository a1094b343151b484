"""The registered corpus queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowassay.llm import (
    chat_format, divergence, embedding_links, extraction, jaccard_join, license_scan, merkle, mixing, packing, paragraph_dedup, quality, suffix_dedup, url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query()
def op9_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf, "pages"))


@query(mixing.MIX_SQL)
def op5_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))


@query()
def op6_quality_trees(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query()
def op10_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query()
def op3_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return extraction.extract(table(spark, sf, "pages"))


@query(embedding_links.NEAR_SQL)
def op7_embedding_links(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_links.near_vectors(table(spark, sf, "embeddings"))


@query(jaccard_join.JOIN_SQL)
def op8_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.join_documents(table(spark, sf, "documents"))


@query()
def op1_paragraph_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return paragraph_dedup.dedup(table(spark, sf, "documents"))


@query()
def op4_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf, "documents"))
    names = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"], x["end"]))
    return found.select("doc_id", "n_licenses", F.array_join(names, " ").alias("licenses"), F.array_min(F.transform("licenses", lambda x: x["coverage"])).alias("least_coverage"))


@query()
def op2_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf, "documents")).drop("spans")


@query(divergence.DIVERGENCE_SQL)
def op11_source_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.divergences(table(spark, sf, "documents"))


@query(chat_format.CHAT_SQL)
def op12_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return chat_format.format_and_read(table(spark, sf, "conversations"), public_tokenizers.path("byte_bpe_50k.json"))


@query(merkle.MANIFEST_SQL)
def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.audit(table(spark, sf, "documents"))
