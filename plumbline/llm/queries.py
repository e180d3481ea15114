"""Registered queries of the operators, and the SQL that checks them where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import align, ann, decontaminate, fingerprint, hpylm, jaccard, pack, quality, secret_scan, substring, toxicity, urls, whitening
from plumbline.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step"]
    return pack.with_steps(packed).select(*names)


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(table(spark, sf_dir, "documents"))


def op4_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.report(secret_scan.scan(docs, secret_scan.fit(docs)))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(substring.repeated(table(spark, sf_dir, "documents")))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(table(spark, sf_dir, "documents"))


def op9_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    outcomes = pages.select(urls.host_of(F.col("url")).alias("host"), urls.page_outcome(F.col("html")).alias("good"))
    return urls.judged(pages, outcomes)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return whitening.whiten(embeddings, whitening.fit(embeddings))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return align.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_packing": op2_packing,
    "op3_pitman_yor": op3_pitman_yor,
    "op4_weak_quality": op4_weak_quality,
    "op5_toxicity": op5_toxicity,
    "op6_secret_scan": op6_secret_scan,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_multi_index_hashing": op9_multi_index_hashing,
    "op10_url_reputation": op10_url_reputation,
    "op11_whitening": op11_whitening,
    "op12_token_alignment": op12_token_alignment,
    "op13_fingerprints": op13_fingerprints,
}
ORACLE = {
    "op1_decontamination": decontaminate.REPORT_SQL,
    "op7_substring_dedup": substring.REPORT_SQL,
    "op10_url_reputation": urls.JUDGED_SQL,
}
