"""Reading and closing editorial items: lists, ranks, previews, nested inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.operators.ranking import active_overrides, lookup


def cluster_inputs(clusters: DataFrame, members: DataFrame, near_misses: DataFrame) -> DataFrame:
    """Clusters with members and near misses as arrays; a near miss shows at the cluster its candidate is in and at the one suggested."""
    m = members.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("candidate_id", "headline", "domain", "quality", "enabled", "reported_at"))).alias("members"))
    sides = near_misses.select(F.explode(F.array_distinct(F.array("current_cluster_id", "suggested_cluster_id"))).alias("cluster_id"), "candidate_id", "reason")
    n = sides.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("candidate_id", "reason"))).alias("near_misses"))
    return clusters.join(m, "cluster_id", "left").join(n, "cluster_id", "left")


def editorial_state(items: DataFrame, overrides: DataFrame) -> DataFrame:
    """(cluster_id, item_status, overrides): what editors decided, ready for ranking."""
    standing = active_overrides(overrides).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("kind", "amount", "text"))).alias("overrides"))
    return items.select("cluster_id", "item_id", F.col("status").alias("item_status")).join(standing, "item_id", "left").drop("item_id")


def finish_rank(items: DataFrame, run_id: Column, merged: DataFrame) -> DataFrame:
    """After a run: ranks of items it did not touch are cleared, items of merged clusters are ineligible."""
    gone = merged.select("cluster_id", F.lit(True).alias("__merged")).distinct()
    marked = items.join(gone, "cluster_id", "left")
    rank = F.when((F.col("run_id") == run_id) & F.col("__merged").isNull(), F.col("rank"))
    return marked.withColumns({"rank": rank, "eligibility": F.when(F.col("__merged"), "ineligible").otherwise(F.col("eligibility"))}).drop("__merged")


def list_items(items: DataFrame, sport: str | None = None, statuses: list[str] | None = None, ranked_only: bool = False, limit: int = 100) -> DataFrame:
    """Items by rank (missing last), then score; at most 1000, the list's own limit."""
    kept = items.filter(F.col("sport") == sport) if sport else items
    kept = kept.filter(F.col("status").isin(*statuses)) if statuses else kept
    kept = kept.filter("rank is not null") if ranked_only else kept
    return kept.orderBy(F.col("rank").asc_nulls_last(), F.col("score").desc(), "cluster_id").limit(min(max(limit, 1), 1000))


def list_clusters(feed: DataFrame, sports: list[str] | None = None, event_type: str | None = None, min_confidence: str = "low", min_sources: int = 1, since: Column | None = None, by_sources: bool = False, limit: int = 50) -> DataFrame:
    """Live clusters, freshest or most reported first; at most 200, the list's own limit."""
    levels = ["low", "medium", "high"]
    kept = feed.filter(F.col("confidence").isin(*levels[levels.index(min_confidence) :]) & (F.col("source_count") >= min_sources))
    kept = kept.filter(F.col("sport").isin(*sports)) if sports else kept
    kept = kept.filter(F.col("event_type") == event_type) if event_type else kept
    kept = kept.filter(F.col("last_seen_at") >= since) if since is not None else kept
    first = [F.col("source_count").desc(), F.col("last_seen_at").desc()] if by_sources else [F.col("last_seen_at").desc(), F.col("source_count").desc()]
    return kept.orderBy(*first, "cluster_id").limit(min(max(limit, 1), 200))


def source_summary(members: DataFrame) -> DataFrame:
    """(cluster_id, domain, n, nth): publishers of a cluster by number of members, then name."""
    n = members.groupBy("cluster_id", "domain").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("nth", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.col("n").desc(), "domain")))


#: What a preview never has: nothing in the warehouse supplies it.
ABSENT = ["deck", "byline", "image", "articleBody", "slug", "credibilityTier"]


def story_previews(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Items that may be shown: a headline, not ineligible, not held or rejected; with the representative's attribution and all reports.

    items: cluster_id, headline, sport, eligibility, status, urgency. sources: cluster_id, publisher, domain, url, quality, is_representative, nth
    (their order, see supporting_sources). What a story lacks is named in ``missing``, never made up.
    """
    safe = (F.trim(F.coalesce("headline", F.lit(""))) != "") & (F.col("eligibility") != "ineligible") & ~F.col("status").isin("held", "rejected")
    report = F.struct("nth", "publisher", "domain", "url", "quality", "is_representative")
    by_cluster = sources.groupBy("cluster_id").agg(F.array_sort(F.collect_list(report)).alias("supporting"))  # a row a publisher
    shown = items.filter(safe).join(by_cluster, "cluster_id", "left")
    one = F.get(F.filter("supporting", lambda r: r["is_representative"]), F.lit(0))
    return shown.select(
        F.col("cluster_id").alias("story_id"),
        "headline",
        "sport",
        F.when(F.col("urgency") == "normal", "none").otherwise("developing").alias("urgency"),
        (F.col("urgency") == "breaking-candidate").alias("breaking_candidate"),
        (F.col("status") == "approved").alias("ready"),
        F.when(one.isNotNull(), F.struct(one["publisher"].alias("publisher"), one["domain"].alias("domain"), one["url"].alias("url"))).alias("attribution"),
        F.coalesce("supporting", F.array().cast("array<struct<nth: int, publisher: string, domain: string, url: string, quality: string, is_representative: boolean>>")).alias("supporting"),
        F.array(*[F.lit(x) for x in ABSENT]).alias("missing"),
    )
