"""One addressable unit into the warehouse: claim, sources, candidates, sightings, rejections, counters; dimensions and their switches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.operators import warehouse


@dataclass
class UnitResult:
    """New rows for each table; ``counters`` is one row. A unit that was taken before gives empty tables and unit_skipped."""

    candidates: DataFrame
    sightings: DataFrame
    rejections: DataFrame
    sources: DataFrame
    counters: DataFrame


def ingest_unit(batch: DataFrame, refused: DataFrame, stored: DataFrame, sources: DataFrame, units: DataFrame, unit_key: str, run_id: str) -> UnitResult:
    """Ingest a unit's accepted (``batch``) and ``refused`` rows. Repeating a unit changes nothing.

    Sources seen first get their bucket; rows of disabled sources become rejections before deduplication; the first row of a
    (kind, headline) in order is its root, an existing root wins; every row, new or known, leaves a sighting.
    """
    fresh = units.filter(F.col("unit_key") == unit_key).isEmpty()
    take = lambda df: df if fresh else df.limit(0)
    batch, refused = take(batch), take(refused)
    seen = batch.select("domain", "name", "quality").unionByName(refused.select("domain", "name", "quality"))
    new_sources = warehouse.upsert_sources(seen).join(sources, "domain", "left_anti").withColumn("enabled", F.lit(True))
    off = sources.filter(~F.col("enabled")).select("domain")
    live, disabled = batch.join(off, "domain", "left_anti"), batch.join(off, "domain", "left_semi")
    flagged = warehouse.ingest_batch(live, stored)
    inserted = flagged.filter("inserted")
    order = Window.partitionBy("headline_kind", "normalized_headline").orderBy("normalized_headline", "normalized_url", "candidate_id")
    known_root = stored.groupBy("headline_kind", "normalized_headline").agg(F.min_by("candidate_id", F.struct(F.col("is_root").cast("int") * -1, "candidate_id")).alias("__root"))
    rooted = inserted.join(known_root, ["headline_kind", "normalized_headline"], "left").withColumn("root_id", F.coalesce("__root", F.first("candidate_id").over(order)))
    candidates = rooted.withColumn("is_root", F.col("root_id") == F.col("candidate_id")).drop("__root", "inserted")
    by_url = stored.select("normalized_url", F.col("candidate_id").alias("__known")).unionByName(inserted.select("normalized_url", F.col("candidate_id").alias("__known")))
    sightings = flagged.join(by_url.groupBy("normalized_url").agg(F.min("__known").alias("canonical_id")), "normalized_url", "left").select(
        "canonical_id", F.lit(run_id).alias("run_id"), F.lit(unit_key).alias("unit_key"), F.col("inserted").alias("created_candidate")
    )
    why = F.array(F.lit("disabled-source"))
    rejections = refused.select("provider", "fingerprint", "reasons").unionByName(disabled.select("provider", "fingerprint", why.alias("reasons")))
    counters = flagged.agg(
        F.count(F.lit(1)).alias("returned"), F.count_if("inserted").alias("inserted"), F.count_if(~F.col("inserted")).alias("duplicates"), F.lit(not fresh).alias("unit_skipped")
    ).crossJoin(rejections.agg(F.count(F.lit(1)).alias("rejected")))  # one row and one row
    return UnitResult(candidates, sightings, rejections, new_sources, counters)


def merge_rejections(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """(provider, fingerprint, reasons, times_seen): seen again adds one, the first reasons stay."""
    new = fresh.groupBy("provider", "fingerprint").agg(F.min("reasons").alias("__reasons"), F.count(F.lit(1)).alias("__n"))
    both = stored.join(new, ["provider", "fingerprint"], "full")
    return both.select("provider", "fingerprint", F.coalesce("reasons", "__reasons").alias("reasons"), (F.coalesce("times_seen", F.lit(0)) + F.coalesce("__n", F.lit(0))).alias("times_seen"))


def sync_providers(stored: DataFrame, described: DataFrame, approved: list[str]) -> DataFrame:
    """Providers (provider_key, label, status) with labels renewed and status kept; unapproved ones are not added."""
    new = described.filter(F.col("provider_key").isin(*approved)).select("provider_key", F.col("label").alias("__label"))
    both = stored.join(new, "provider_key", "full")
    return both.select("provider_key", F.coalesce("__label", "label").alias("label"), F.coalesce("status", F.lit("enabled")).alias("status"))


def set_enabled(sources: DataFrame, domain: str, enabled: bool) -> DataFrame:
    return sources.withColumn("enabled", F.when(F.col("domain") == domain, F.lit(enabled)).otherwise(F.col("enabled")))


def headline_kind(provider: Column, may_show: list[str]) -> Column:
    """publisher-title for providers whose policy lets their headlines be shown, else discovery-text."""
    return F.when(provider.isin(*may_show), "publisher-title").otherwise("discovery-text")


def feed_state(state: Column, units_done: Column, errors: Column) -> Column:
    """A provider's state after a run: an ok answer with errors and nothing done is an error."""
    return F.when((state == "ok") & (errors > 0) & (units_done == 0), "error").otherwise(state)
