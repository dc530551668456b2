"""Exact length histograms of encoded documents."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import doc_batches, materialize
from tickerloom.llm.tokens import default_vocabulary, encoder

#: Lengths to a block; suffix sums go over the blocks, then within each.
BLOCK = 1 << 8


def length_histogram(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """n_tokens and n_docs for every encoded length that occurs. Each task counts first: a row for each length and task is shuffled.

    The histogram (a row a length) is written down, so that what reads it several times encodes the corpus once. Null or empty text
    has length 0. Very long texts are encoded piece by piece, never cut. Repeated rows count each, ties do not arise. Empty table: no rows.
    Other columns are ignored, whatever their names.
    """
    path = vocabulary or default_vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[int] = Counter()
        for _, texts in doc_batches(batches):
            found.update(map(len, encoder(path).each(texts)))
        if found:
            yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(found.keys(), pa.int64()), "n": pa.array(found.values(), pa.int64())})

    counted = docs.select("text").mapInArrow(count, "n_tokens long, n long").groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))
    return materialize(counted, "lengths")


def context_limits(histogram: DataFrame) -> DataFrame:
    """Suffix sums of a length histogram, a row for every length L that occurs:

    docs_at_least and tokens_at_least (documents of L tokens or more, and their tokens), docs_share (share of documents of at
    most L tokens), truncated_tokens (tokens left when every document is cut at L). Between two lengths all of them but
    truncated_tokens are constant, and that grows by docs_at_least a token, so the table answers every limit.
    """
    blocked = histogram.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens"))
    everything = Window.partitionBy()
    after = sums.select(
        "block",
        F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("tokens").over(later), F.lit(0)).alias("tokens_after"),
        F.sum("docs").over(everything).alias("docs_all"),
        F.sum("tokens").over(everything).alias("tokens_all"),
    )
    down = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    summed = (
        blocked.join(after, "block")
        .withColumn("docs_at_least", F.col("docs_after") + F.sum("n_docs").over(down))
        .withColumn("tokens_at_least", F.col("tokens_after") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(down))
    )
    return summed.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        ((F.col("docs_all") - F.col("docs_at_least") + F.col("n_docs")) / F.col("docs_all")).alias("docs_share"),
        (F.col("tokens_all") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias("truncated_tokens"),
    )


def length_quantile(limits: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share ``q`` of the documents do not exceed; null for no documents."""
    return limits.filter(F.col("docs_share") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(limits: DataFrame, limit: int) -> DataFrame:
    """Tokens left when every document is cut at ``limit`` tokens; 0 for no documents."""
    longer = limits.filter(F.col("n_tokens") >= limit).agg(F.max("docs_at_least").alias("docs"))
    shorter = limits.filter(F.col("n_tokens") < limit).agg(F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens"))
    return longer.join(shorter).select((F.coalesce("tokens", F.lit(0)) + F.coalesce("docs", F.lit(0)) * limit).alias("tokens"))
