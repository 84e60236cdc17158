"""The corpus pipeline: ordered stages, each one operator over what the last one kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but
the last return the columns of documents. Between stages the rows are written
as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhall.llm import packing, quality_rules, secret_scan, simhash, suffix_dedup
from tallyhall.llm.common import discard, documents, stash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule keeps.

    Null and empty texts have no words and go. Repeated rows and ids are judged
    alike, each on its own; there are no ties. An empty table gives an empty
    one, here and in every stage; columns other than those of documents go.
    """
    return quality_rules.keep(docs.select(*COLUMNS))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that with the least doc_id.

    Rows that share id and text are one document; rows that share only the id
    are not. A row without an id comes after those with one; of equal ids the
    lesser hash of id and text stays. Null texts are empty, and texts without
    words are one class.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select(*COLUMNS, F.xxhash64(F.col("doc_id").isNull(), "doc_id", text).alias("_key"))
    found = simhash.near_duplicates(own, id_col="_key").select(F.col("doc_id").alias("_key"), "component_id").distinct()
    rank = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key"))["_key"]
    first = own.select("_key", "doc_id").distinct().join(found, "_key").groupBy("component_id").agg(rank.alias("_key")).select("_key")
    return own.join(first, "_key", "left_semi").dropDuplicates(["_key"]).select(*COLUMNS)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that start elsewhere too; documents of which nothing is left go.

    A cut inside a character drops what is left of that character. Null and
    empty texts have nothing to lose and stay; repeated rows and ids are
    documents of their own; there are no ties.
    """
    out = suffix_dedup.remove_repeats(docs.select(*COLUMNS))
    left = F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "\\x{FFFD}", "")
    text = F.when(F.size("removed") == 0, F.col("text")).otherwise(left)
    kept = out.filter((F.size("removed") == 0) | (F.octet_length("kept") > 0)).withColumn("text", text)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced by a mark.

    Null and empty texts stay as they are; repeated rows and ids are treated
    alike; a candidate with tied votes is a secret.
    """
    out = secret_scan.redact(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, placed in sequences of 4096 tokens.

    A null or empty text is one end id; repeated rows and ids are packed as
    documents of their own; of groupings with equally many bins any may win.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("suffix-array dedup", repeats_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]

#: Tokenizing and the tie order of packing are beyond SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``; what a stage returns is written and read again."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        before, docs = docs, stash(stage(spark, docs, sf_dir), "stage")
        discard(before)
    return docs
