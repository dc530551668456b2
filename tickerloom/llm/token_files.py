"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import doc_batches
from tickerloom.llm.tokens import END_ID, default_vocabulary, encoder


#: Tokens of one record batch.
BATCH_TOKENS = 500_000


def _bounds(docs: DataFrame, files: int) -> np.ndarray:
    """Where ``files`` ranges of doc_id meet (null as the smallest); an id of many rows may be several of them. Reads doc_id only."""
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(np.iinfo(np.int64).min))
    at = docs.agg(F.percentile_approx(ids, [k / files for k in range(1, files)], max(10_000, 10 * files))).first()[0] if files > 1 else None
    return np.array(at or [], np.int64)


def encode_documents(docs: DataFrame, bounds: np.ndarray, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """part, doc_id, n_tokens, ids_crc32 and ids (with ``end_id``) of each document; null text counts as empty.

    part is the range of doc_id; rows of an id at which ranges meet are dealt to all of these in turn.
    """
    path = vocabulary or default_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, turn = np.array([end_id], "<u4"), TaskContext.get().partitionId()
        for batch, texts in doc_batches(batches):
            doc_ids, parts, held, first = batch.column("doc_id").cast(pa.int64()), [], 0, 0
            known = doc_ids.fill_null(np.iinfo(np.int64).min).to_numpy()
            low, high = np.searchsorted(bounds, known, "left"), np.searchsorted(bounds, known, "right")
            files = pa.array((low + (turn + np.arange(len(known))) % (high - low + 1)).astype(np.int32))
            turn += len(known)
            for k, ids in enumerate(encoder(path).each(texts), 1):
                parts.append(np.append(ids, end))
                held += len(parts[-1])
                if held > BATCH_TOKENS or k == len(texts):
                    ends = np.cumsum([0, *map(len, parts)])
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).view(np.int32)))
                    sums = pa.array([zlib.crc32(x) for x in parts], pa.int64())
                    columns = [files.slice(first, len(parts)), doc_ids.slice(first, len(parts)), pa.array(np.diff(ends)), sums, lists]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "n_tokens", "ids_crc32", "ids"])
                    parts, held, first = [], 0, k

    return docs.select("doc_id", "text").mapInArrow(encode, "part int, doc_id long, n_tokens long, ids_crc32 long, ids array<int>")


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, stripe_mb: int = 32, index_stride: int = 1000, files: int | None = None) -> None:
    """Write the ids of all documents to ORC files below ``path`` in ascending doc_id order (null first).

    The ``files`` files (the session's number of shuffle partitions) hold ranges of doc_id, rows within them are sorted by doc_id,
    length and checksum. ORC codes the ids as integer runs; each stripe has minimum, maximum and a Bloom filter of doc_id for every
    ``index_stride`` rows, so a look-up by id reads few row groups, and readers split files by stripes. Texts are encoded where they
    lie, once; only ids are shuffled. Rows without a doc_id, or many of one, are dealt to several files.

    Null text: only ``end_id``. Very long texts: encoded piece by piece, one row. Repeated rows: written each. Empty table: no rows.
    Other columns of ``docs`` are left out, whatever their names.
    """
    files = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        encode_documents(docs, _bounds(docs, files), vocabulary, end_id)
        .repartitionById(files, "part")
        .sortWithinPartitions("doc_id", "n_tokens", "ids_crc32")
        .select("doc_id", "n_tokens", "ids")
        .write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", str(stripe_mb << 20))
        .option("orc.row.index.stride", str(index_stride))
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens and ids as they lie in the files; a filter on doc_id prunes stripes and row groups by their metadata."""
    return spark.read.schema("doc_id long, n_tokens long, ids array<int>").orc(path)


def token_offsets(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files below ``path``: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Checksums are taken from the ids read, stripe by stripe; starts are running sums within a file on top of the sums of the
    files before it (one row a file). Repeated doc_ids follow each other by n_tokens, then checksum, in each of their files in turn. No documents: no rows.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ends = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.array(sums, pa.int64()), batch.column("file")], ["doc_id", "n_tokens", "ids_crc32", "file"])

    read = read_token_files(spark, path).select("doc_id", "ids", F.col("_metadata.file_name").alias("file"))
    rows = read.mapInArrow(check, "doc_id long, n_tokens long, ids_crc32 long, file string")
    by_file = Window.orderBy("first", "last", "file")
    files = (
        read_token_files(spark, path)
        .groupBy(F.col("_metadata.file_name").alias("file"))
        .agg(F.sum("n_tokens").alias("here"), F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("first"), F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("last"))
        .select("file", (F.sum("here").over(by_file) - F.col("here")).alias("before"))
    )
    in_file = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("upto", F.sum("n_tokens").over(in_file))
        .join(files, "file")
        .select("doc_id", (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")
    )
