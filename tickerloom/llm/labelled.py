"""Bounded, reproducible samples of labelled documents, by class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id's decimal text modulo ``folds``; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def held_out(doc_id: Column, folds: int, fold_out: int) -> Column:
    """Whether labels of this document are kept from training; so are those of a null doc_id."""
    return F.coalesce(fold(doc_id, folds) == fold_out, F.lit(True))


def class_counts(labels: DataFrame, label: str, folds: int, fold_out: int) -> dict[int, int]:
    """Training labels by class."""
    usable = labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), folds, fold_out))
    return {int(r[0]): r[1] for r in usable.groupBy(label).count().collect()}


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold_out: int, most: int) -> DataFrame:
    """(text, y) of at most ``most`` labelled training documents of each class, taken by a hash of doc_id.

    Only labels are sampled; a label whose document is missing is lost. A doc_id labelled twice counts with its larger label; of
    several rows of a doc_id the smallest text counts.
    """
    usable = labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), folds, fold_out))
    one = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    picked = None
    for y in (0, 1):
        some = one.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = some if picked is None else picked.unionByName(some)
    # At most 2 * most rows of two numbers.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y")
