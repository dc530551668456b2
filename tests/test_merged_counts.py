"""Merges of a stored table that keeps some of the aggregates only."""

import datetime as dt

from tickerloom.operators import commands

MEMBER = "candidate_id long, cluster_id long, source string, quality string, enabled boolean, fresh_at timestamp, discovered_at timestamp, published_at timestamp, sport string, league string, headline string, headline_kind string, event_type string, confidence string"


def test_only_the_aggregates_kept_are_recomputed(spark):
    at = dt.datetime(2024, 1, 1)
    m = spark.createDataFrame([(i, c, f"s{i % 2}", "known", True, at, at, at, "golf", None, f"report number {i}", "publisher-title", "trade", "high") for i, c in enumerate([1, 1, 2, 2, 2, 3])], MEMBER)
    stored = spark.createDataFrame([(1, "open", None, 2, 2), (2, "stable", None, 3, 2), (3, "open", None, 1, 1)], "cluster_id long, status string, merged_into_id long, candidate_count long, source_count long")
    c = spark.createDataFrame([(1, at, 1, 2)], "command_id long, at timestamp, from_id long, into_id long")
    after = commands.merge_stored(stored, m, m.selectExpr("candidate_id", "3L as cluster_id", "0.5D as score"), c)[0]
    assert sorted(map(tuple, after.collect())) == [(1, "closed", 2, 0, 0), (2, "open", None, 5, 2), (3, "open", None, 1, 1)]
