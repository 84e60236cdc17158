"""The registered ``opN_`` queries: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyhall.llm import byte_bpe, dac, media_source, packing, quality_knn, quality_rules, secret_scan, simhash, suffix_dedup, toxicity
from tallyhall.llm.common import documents, tuned


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as token-ID files and report each from the files."""
    tuned(spark)
    return dac.read_tokens(dac.write_tokens(documents(spark, sf_dir)))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    return quality_rules.query(spark, sf_dir)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate secret of every document, with its verdict."""
    return secret_scan.findings(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to repeated 200-byte strings."""
    return suffix_dedup.digest(documents(spark, sf_dir))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_knn.classify(documents(spark, sf_dir), _labels(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.classify(documents(spark, sf_dir), _labels(spark, sf_dir))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of both."""
    return byte_bpe.encode_decode(documents(spark, sf_dir))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every document as an image in archives and describe what is read back."""
    return media_source.media_features(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 4096 tokens."""
    return packing.pack_documents(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_quality_rules, op3_secret_scan, op4_suffix_dedup, op5_quality_classifier, op6_toxicity, op7_byte_bpe, op8_media, op9_packing, op10_token_store)}
ORACLES: dict[str, str] = {"op2_quality_rules": quality_rules.ORACLE}
