"""Deduplicating ingest with provenance, headline groups, feeds and statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.operators.clustering import components


def first_wins(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row a key, the first in order, and ``copies``: how many rows had it. A key's rows are reduced before they are shuffled."""
    row = F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], F.struct("*").alias("__row"))
    picked = df.groupBy(F.col(key).alias("__key")).agg(F.min(row).alias("__first"), F.count(F.lit(1)).alias("copies"))
    return picked.select("__first.__row.*", "copies")


def flag_copies(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """Adds ``duplicate``: true for every row of a key after the first in order."""
    return df.withColumn("duplicate", F.row_number().over(Window.partitionBy(key).orderBy(*order)) > 1)


def item_key() -> Column:
    """Provider and item as one key; null without an item."""
    return F.when(F.col("provider_item_id").isNotNull(), F.concat_ws("\x01", F.col("provider").cast("string"), "provider_item_id"))


def ingest_batch(batch: DataFrame, stored: DataFrame, stored_items: DataFrame | None = None) -> DataFrame:
    """Adds ``inserted`` to a batch of (candidate_id, normalized_url, provider, provider_item_id, normalized_headline).

    A row is inserted unless a stored or an earlier inserted row of the batch (by headline, then URL) has its URL or its
    (provider, item). The two keys interact, so rows are first joined into components of shared keys (see ``_grouped``) and each component is walked in order; rows without a second key never leave the JVM.
    stored_items (item_key): the stored items where a table of their own holds them, see operators/store.py.
    """
    item = item_key()
    known_url = stored.select(F.col("normalized_url").alias("__url")).distinct()
    items = stored.select(item.alias("__item")) if stored_items is None else stored_items.select(F.col("item_key").alias("__item"))
    known_item = items.filter("__item is not null").distinct()
    rows = batch.withColumn("__item", item)
    rows = rows.join(known_url.withColumn("__known_url", F.lit(True)), rows["normalized_url"] == F.col("__url"), "left").drop("__url")
    # Rows without an item all share the null key: they stay out of the join by item.
    found = rows.filter("__item is not null").join(known_item.withColumn("__known_item", F.lit(True)), "__item", "left")
    rows = found.unionByName(rows.filter("__item is null").withColumn("__known_item", F.lit(None).cast("boolean")))
    rows = rows.withColumn("__stored", F.col("__known_url").isNotNull() | F.col("__known_item").isNotNull()).drop("__known_url", "__known_item")
    order = [F.col("normalized_headline"), F.col("normalized_url"), F.col("candidate_id")]
    items = rows.filter("__item is not null").groupBy("__item").agg((F.min("normalized_url") < F.max("normalized_url")).alias("__shared")).filter("__shared").select("__item")
    urls = rows.join(items, "__item", "left_semi").select(F.col("normalized_url").alias("__url"), F.lit(True).alias("__tied")).distinct()
    rows = rows.join(urls, rows["normalized_url"] == F.col("__url"), "left").withColumn("__tied", F.col("__tied").isNotNull()).drop("__url")
    free, tied = rows.filter(~F.col("__tied")), rows.filter("__tied")
    first = F.row_number().over(Window.partitionBy("normalized_url").orderBy(F.col("__stored").asc(), *order)) == 1
    free = free.withColumn("inserted", ~F.col("__stored") & first).drop("__item", "__stored", "__tied")
    out_schema = free.schema

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        seen_urls, seen_items, flags = set(), set(), []
        pdf = pdf.sort_values(["normalized_headline", "normalized_url", "candidate_id"], kind="stable")
        for r in pdf.itertuples(index=False):
            row = r._asdict() if hasattr(r, "_asdict") else {}
            url, key, stored_already = row["normalized_url"], row["item_key"], row["is_stored"]
            ok = not stored_already and url not in seen_urls and (key is None or key not in seen_items)
            if ok:
                seen_urls.add(url)
                if key is not None:
                    seen_items.add(key)
            flags.append(ok)
        return pdf.assign(inserted=flags)[[f.name for f in out_schema]]

    grouped = _grouped(tied).withColumnRenamed("__item", "item_key").withColumnRenamed("__stored", "is_stored").drop("__tied")
    return free.unionByName(grouped.groupBy("component").applyInPandas(walk, out_schema))


def _grouped(tied: DataFrame) -> DataFrame:
    """Adds ``component``: the smallest URL reachable over shared URLs and items (only rows whose keys do interact come here)."""
    root = tied.filter("__item is not null").groupBy("__item").agg(F.min("normalized_url").alias("neighbour_id"))
    edges = tied.join(root, "__item").select(F.col("normalized_url").alias("candidate_id"), "neighbour_id").filter("candidate_id <> neighbour_id")
    label = components(edges, tied.select(F.col("normalized_url").alias("candidate_id")).distinct())
    return tied.join(label.withColumnRenamed("candidate_id", "normalized_url"), "normalized_url")


def headline_groups(candidates: DataFrame) -> DataFrame:
    """One row per (kind, normalized_headline): sample, counts, distinct sources and providers, times, root, most frequent sport."""
    key = ["headline_kind", "normalized_headline"]
    sports = candidates.groupBy(*key, "sport").agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(F.min(F.struct(-F.col("n"), "sport")).alias("m"))
    groups = candidates.groupBy(*key).agg(
        F.min_by("headline", F.struct("created_at", "candidate_id")).alias("sample_headline"),
        F.count(F.lit(1)).alias("candidate_count"),
        F.count_distinct("source").alias("source_count"),
        F.count_distinct("provider").alias("provider_count"),
        F.min("discovered_at").alias("first_seen_at"),
        F.max("discovered_at").alias("last_seen_at"),
        F.min("published_at").alias("first_published_at"),
        F.min_by("candidate_id", F.struct("created_at", "candidate_id")).alias("root_id"),
    )
    return groups.join(sports.select(*key, F.col("m.sport").alias("sport")), key)


def upsert_sources(seen: DataFrame) -> DataFrame:
    """(domain, name, quality) of each domain: rows with a name before those without, then quality in text order, then name."""
    in_domain = Window.partitionBy("domain").orderBy(F.col("name").isNull(), F.col("quality"), F.col("name").asc_nulls_last())
    return seen.withColumn("__n", F.row_number().over(in_domain)).filter("__n = 1").select("domain", "name", "quality")


def rejection_log(rejections: DataFrame) -> DataFrame:
    """One row per (provider, fingerprint): how often seen (once a batch), first and last batch, reasons of the first sighting."""
    in_batch = Window.partitionBy("provider", "fingerprint", "batch").orderBy("source_url")
    once = rejections.withColumn("__n", F.row_number().over(in_batch)).filter("__n = 1")
    return once.groupBy("provider", "fingerprint").agg(
        F.count(F.lit(1)).alias("times_seen"),
        F.min("batch").alias("first_batch"),
        F.max("batch").alias("last_batch"),
        F.min_by("reasons", F.struct("batch", "source_url")).alias("reasons"),
    )


def candidate_feed(
    candidates: DataFrame,
    sources: DataFrame,
    since: Column | None = None,
    sports: list[str] | None = None,
    min_confidence: str | None = None,
    statuses: tuple[str, ...] = ("new", "accepted"),
    publisher_only: bool = True,
    limit: int = 50,
    providers: list | None = None,
    qualities: list[str] | None = None,
    published: tuple[Column | None, Column | None] = (None, None),
    discovered: tuple[Column | None, Column | None] = (None, None),
    disabled_sources: bool = False,
) -> DataFrame:
    """Freshest candidates, newest first, 1 to 500; the limit is part of the feed.

    Every knob that is left out lets everything pass, but only enabled sources and publisher titles show unless asked for. Both
    ends of a range count; a missing time is in no range. Filters stand before the join, so that they reach the scan.
    """
    levels = ["low", "medium", "high"]
    kept = candidates.withColumn("fresh_at", F.coalesce("published_at", "discovered_at")).filter(F.col("status").isin(*statuses))
    for column, (low, high) in (("fresh_at", (since, None)), ("published_at", published), ("discovered_at", discovered)):
        kept = kept if low is None else kept.filter(F.col(column) >= low)
        kept = kept if high is None else kept.filter(F.col(column) <= high)
    for column, allowed in (("sport", sports), ("provider", providers), ("confidence", min_confidence and levels[levels.index(min_confidence) :])):
        kept = kept.filter(F.col(column).isin(*allowed)) if allowed else kept
    if publisher_only:
        kept = kept.filter(F.col("headline_kind") == "publisher-title")
    known = sources if disabled_sources else sources.filter("enabled")
    known = known.filter(F.col("quality").isin(*qualities)) if qualities else known
    joined = kept.join(known.select("source", "source_name"), "source")
    title = F.when(F.col("headline_kind") == "publisher-title", F.col("headline"))
    prose = F.when(F.col("headline_kind") != "publisher-title", F.col("headline"))
    return joined.withColumns({"publisher_headline": title, "discovery_text": prose}).orderBy(F.col("fresh_at").desc(), F.col("candidate_id").desc()).limit(min(max(limit, 1), 500))


def warehouse_stats(candidates: DataFrame) -> DataFrame:
    """(metric, key, value) rows: totals, duplicate rate, counts by sport, confidence, provider and status."""
    row = lambda metric, key, value: F.struct(F.lit(metric).alias("metric"), F.lit(key).cast("string").alias("key"), value.cast("double").alias("value"))
    n, groups = F.count(F.lit(1)), F.count_distinct(F.struct("headline_kind", "normalized_headline"))
    totals = candidates.agg(
        F.array(
            row("candidates", None, n),
            row("headlines", None, groups),
            row("published", None, F.count_if(F.col("published_at").isNotNull())),
            row("duplicate_rate", None, F.round(F.when(n == 0, 0.0).otherwise(1 - groups / n).cast("decimal(20,10)"), 4)),
        ).alias("r")
    ).select(F.inline("r"))
    for by in ("sport", "confidence", "provider", "status"):
        totals = totals.unionByName(candidates.groupBy(by).agg(n.cast("double").alias("value")).select(F.lit(f"by_{by}").alias("metric"), F.col(by).cast("string").alias("key"), "value"))
    return totals


def warehouse_report(candidates: DataFrame, observations: DataFrame, sources: DataFrame, rejections: DataFrame, runs: DataFrame, since: Column) -> DataFrame:
    """Further (metric, key, value) rows: candidates since a time, observations, sources, rejections by reason, runs by status, quality."""
    one = lambda df, **counts: df.agg(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(None).cast("string").alias("key"), c.cast("double").alias("value")) for m, c in counts.items()]).alias("r")).select(F.inline("r"))
    by = lambda df, metric, key: df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(metric).alias("metric"), "key", "value")
    n = F.count(F.lit(1))
    parts = [
        one(candidates, new_recent=F.count_if(F.col("discovered_at") >= since)),
        one(observations, observations=n),
        one(sources, sources=n, disabled_sources=F.count_if(~F.col("enabled"))),
        one(rejections, rejections=n),
        by(rejections.select(F.explode("reasons").alias("reason")), "by_reason", "reason"),
        by(runs, "runs_by_status", "status"),
        by(candidates, "by_quality", "quality"),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def top_groups(candidates: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` headline groups of more than one candidate with the most sources, then the most candidates; ties by headline."""
    repeated = headline_groups(candidates).filter("candidate_count > 1")
    return repeated.orderBy(F.desc("source_count"), F.desc("candidate_count"), "normalized_headline", "headline_kind").limit(n)


def latest_run(runs: DataFrame) -> DataFrame:
    """The run that started last (ties to the larger id), as one row."""
    return runs.agg(F.max_by(F.struct(*runs.columns), F.struct("started_at", "run_id")).alias("r")).filter("r is not null").select("r.*")


def unclustered(candidates: DataFrame, members: DataFrame, since: Column | None = None, limit: int | None = None) -> DataFrame:
    """Candidates that belong to no cluster, oldest first: the work queue."""
    queue = candidates.join(members.select("candidate_id"), "candidate_id", "left_anti").withColumn("fresh_at", F.coalesce("published_at", "discovered_at"))
    queue = queue.filter(F.col("fresh_at") >= since) if since is not None else queue
    return queue.orderBy("fresh_at", "candidate_id").limit(limit) if limit else queue


def first_n(df: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """At most ``n`` rows of each key; Spark limits each key's rows before the shuffle."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("nth") <= n)


def pending_units(available: DataFrame, processed: DataFrame) -> DataFrame:
    """Addressable units not yet stored, oldest first: the exactly-once cursor."""
    return available.join(processed.select("unit_key").distinct(), "unit_key", "left_anti").orderBy("unit_key")


def run_status(state: Column, processed: Column, errors: Column) -> Column:
    """failed, partial or succeeded for an ingest run."""
    return F.when(state.isin("error", "throttled", "unavailable") & (processed == 0), "failed").when(errors > 0, "partial").otherwise("succeeded")


def reap_stale(runs: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Running for longer than ``minutes``: failed, with the reason."""
    stale = (F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"INTERVAL {minutes} MINUTES"))
    return runs.withColumns({"error_message": F.when(stale, "stale run reaped").otherwise(F.col("error_message")), "finished_at": F.when(stale, now).otherwise(F.col("finished_at")), "status": F.when(stale, "failed").otherwise(F.col("status"))})
