"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str, folds: int, fold: int):
    """Whether a document belongs to the fold that is never learnt from: crc32 of its id as text."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, at_most: dict[int, int]) -> DataFrame:
    """``text, label`` of at most so many documents of each class, none of them held out.

    Which ones is decided by a hash of the id, so it doesn't depend on
    partitions. The ids are at most ``sum(at_most.values())`` rows: they are
    joined to the texts by broadcast.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, fold))
    known = known.groupBy("doc_id").agg(F.max(label).alias("label"))
    parts = [known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in at_most.items()]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    return docs.select("doc_id", "text").dropna(subset=["doc_id"]).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "label")
