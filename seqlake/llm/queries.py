"""One query for each operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, divergence, licenses, media, minhash, pii, secret_scan, shards, spelling, sql, suffix_index, toxicity, warc
from .common import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(table(spark, sf_dir, "documents"), RANKS)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(table(spark, sf_dir, "documents"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))).withColumn("_secrets", secret_scan.secrets())
    places = F.transform("_secrets", lambda c: F.concat(c["start"].cast("string"), F.lit(":"), c["end"].cast("string")))
    return out.select(
        "doc_id", F.size("_scan.candidates").cast("long").alias("n_candidates"), F.size("_secrets").cast("long").alias("n_secrets"),
        F.array_join(places, ",").alias("spans"), F.sha2("_scan.redacted", 256).alias("redacted_sha256"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.scan(table(spark, sf_dir, "documents"))
    every = F.array_sort(F.concat("_pii.base", "_pii.more"))
    return out.select("doc_id", *(pii.count(k).alias(f"n_{k}") for k in pii.KINDS), F.sha2(pii.listed(F.col("_pii.base")), 256).alias("base_sha256"), pii.listed(every).alias("spans"), F.col("_pii.scored").alias("n_scored"), F.size("_pii.more").cast("long").alias("n_added"))


def op7_suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_index.remove(table(spark, sf_dir, "documents"), 200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.round_trip(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=~toxicity.held_out(F.col("id")))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(table(spark, sf_dir, "documents"), path).select("doc_id", "_license.headers", "_license.score", "_license.own", "_license.inherited", F.col("_license.source").alias("inherited_from"), "_license.license")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(spelling.vocabulary(table(spark, sf_dir, "documents"), spoil=199, least_points=6, least_count=5), ratio=5)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=3, top=200)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"), 16)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash, op2_secrets, op3_decontaminate, op4_warc, op5_byte_bpe, op6_pii, op7_suffix_index, op8_media, op9_toxicity, op10_licenses, op11_spelling, op12_divergence, op13_sharding)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
