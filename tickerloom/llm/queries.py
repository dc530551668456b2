"""The numbered queries: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm import decontamination, divergence, embedding_dedup, jaccard_join, line_dedup, neighbours, packing, quality, secrets, token_counts, token_files, toxicity, whitening
from tickerloom.llm.common import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.context_limits(token_counts.length_histogram(_table(spark, sf_dir, "documents")))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, k=5)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = decontamination.contaminated_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return pairs.select("doc_id", "item_id", "n_match", "window")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "op7")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path)
    return token_files.token_offsets(spark, path)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(_table(spark, sf_dir, "documents"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_documents(_table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["layers"] == "")
    of_kind = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of_kind(k) for k in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("secrets")).alias("spans"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(_table(spark, sf_dir, "documents"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_nearest_neighbours, op3_packing, op4_quality, op5_decontamination, op6_toxicity, op7_token_files, op8_line_dedup, op9_jaccard_join, op10_secret_scans, op11_source_divergence, op12_embedding_dedup, op13_embedding_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": decontamination.SQL, "op8_line_dedup": line_dedup.SQL, "op11_source_divergence": divergence.oracle()}
