"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, html_extract, langid, longest_match, media, mixing, quality, resampling, secret_scan, simhash, url_filter, warc
from .runtime import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the five fixed rules."""
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.QUERY_RULES)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target and what the mix takes of it."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op4_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as lossless WebP, read back and described."""
    return media.read_back(media.store(table(spark, sf_dir, "documents")))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every text with its kind, score and verdict."""
    return secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.train(spark))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text, encoded and decoded."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), *bpe.default_vocabulary())


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learnt from those not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs, ~langid.held_out(docs["doc_id"]))
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record, looked up by its URL and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the isolation forest's verdict of every document."""
    measured = quality.measure(table(spark, sf_dir, "documents"))
    return quality.judge(measured, quality.learn(measured, table(spark, sf_dir, "labels")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight towards the benchmark's texts, its score and its rank among those drawn."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that strings of 100 bytes cover which start earlier."""
    return longest_match.digests(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all pairs of sources of a language, and the terms that set each source apart."""
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_html_extraction": op2_html_extraction,
    "op3_mixing": op3_mixing,
    "op4_media_webp": op4_media_webp,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_secret_scans": op6_secret_scans,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_language_id": op8_language_id,
    "op9_warc": op9_warc,
    "op10_quality_forest": op10_quality_forest,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op1_url_filters": url_filter.ORACLE_SQL,
    "op9_warc": warc.ORACLE_SQL,
    "op11_importance_resampling": resampling.ORACLE_SQL,
    "op13_source_divergence": divergence.ORACLE_SQL,
}
