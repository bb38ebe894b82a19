"""Registered queries of the training-data operators, and their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontaminate, jaccard_join, media_jpeg, packing, pii, quality_pu, secret_scan, simhash, substring_dedup, toxicity, url_filter
from .common import durable, read_table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return url_filter.judge(url_filter.captures_of(pages), url_filter.entries_of(pages))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_pu.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))



def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_jpeg.digests(media_jpeg.store_texts(read_table(spark, sf_dir, "documents")))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(read_table(spark, sf_dir, "documents"), k=4, num=85, den=100)



def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan_documents(read_table(spark, sf_dir, "documents")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = durable(pii.detect(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "candidates"), "candidates")
    return pii.digests(pii.label(found, pii.fit(found)))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read_table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.similar(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filters, op2_packing, op3_quality_classifier, op4_benchmark_decontamination, op5_suffix_array_dedup, op6_toxicity, op7_media_columns, op8_ngram_jaccard_join, op9_secret_scans, op10_pii, op11_collocations, op12_simhash)}

ORACLES: dict[str, str] = {"op1_url_filters": url_filter.ORACLE, "op4_benchmark_decontamination": decontaminate.ORACLE, "op8_ngram_jaccard_join": jaccard_join.ORACLE, "op11_collocations": collocations.ORACLE}
