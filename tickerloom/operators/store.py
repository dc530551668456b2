"""A store of candidates that only grows, bucketed by the keys that new batches are held against.

Two tables: rows by URL, and item keys by item. A batch is shuffled into the stored buckets; what is stored is neither
shuffled nor sorted again, however large it has grown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.operators import warehouse
from tickerloom.storage import discard, written

COLUMNS = ["candidate_id", "normalized_url", "provider", "provider_item_id", "normalized_headline"]


def _append(df: DataFrame, table: str, key: str, buckets: int) -> None:
    writer = df.repartition(buckets, key).write.mode("append").bucketBy(buckets, key).sortBy(key)
    # Row groups of other URLs are skipped by their Bloom filters.
    writer.option(f"parquet.bloom.filter.enabled#{key}", "true").format("parquet").saveAsTable(table)


def create_store(spark: SparkSession, name: str, buckets: int) -> None:
    """Empty tables ``name`` and ``name_items``. Buckets are for the size that the store will have: at least the shuffle partitions of a session,
    as Spark deals both sides out anew otherwise."""
    empty = spark.createDataFrame([], "candidate_id long, normalized_url string, provider long, provider_item_id string, normalized_headline string")
    _append(empty, name, "normalized_url", buckets)
    _append(empty.select(warehouse.item_key().alias("item_key")), f"{name}_items", "item_key", buckets)


def _buckets(spark: SparkSession, name: str) -> int:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Num Buckets'").collect()
    return int(rows[0]["data_type"])


def judged(spark: SparkSession, name: str, batch: DataFrame) -> DataFrame:
    """The batch with ``inserted``, see ingest_batch."""
    return warehouse.ingest_batch(batch.select(*COLUMNS), spark.table(name), spark.table(f"{name}_items"))


def ingest(spark: SparkSession, name: str, batch: DataFrame) -> DataFrame:
    """Judge a batch, append what is inserted to both tables, and give the judged batch back. Run again with the same batch, nothing is
    inserted, and what a failure between the two tables left out is made up."""
    n = _buckets(spark, name)
    found = written(judged(spark, name, batch))
    new = found.filter("inserted").select(*COLUMNS)
    # Items first: a row whose URL is stored is never new again, so its item must be there by then.
    keys = new.select(warehouse.item_key().alias("item_key")).filter("item_key is not null").distinct()
    _append(keys, f"{name}_items", "item_key", n)
    _append(new, name, "normalized_url", n)
    return found
