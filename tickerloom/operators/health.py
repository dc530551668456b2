"""Pipeline health: streaks, lags, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions import times

STATES = ["healthy", "unknown", "disabled", "degraded", "stale", "down"]


def leading_streaks(runs: DataFrame, key: str, at: str, recent: int = 30) -> DataFrame:
    """For each key, of its ``recent`` newest runs (test runs must be left out before): how many newest finished ones in a row failed, were throttled
    and were empty; the last success (finished well and answered), last attempt, newest finished run's status, newest error.

    Needs run_id, status, provider_state and, as far as known, finished_at and error_message.
    """
    column = lambda c, kind: F.col(c) if c in runs.columns else F.lit(None).cast(kind)
    tidy = runs.select(key, F.col(at).alias("__at"), "run_id", "status", "provider_state", column("finished_at", "timestamp").alias("__end"), column("error_message", "string").alias("__error"))
    kept = tidy.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.col("__at").desc(), F.col("run_id").desc()))).filter(F.col("__n") <= recent)
    done = F.col("status") != "running"
    place = F.sum(done.cast("int")).over(Window.partitionBy(key).orderBy("__n").rowsBetween(Window.unboundedPreceding, 0))
    kept = kept.withColumns({"__done": done, "__k": place, "__end": F.coalesce("__end", "__at")})
    n = F.sum(F.col("__done").cast("long"))
    streak = lambda test: F.coalesce(F.min(F.when(F.col("__done") & ~F.coalesce(test, F.lit(False)), F.col("__k"))) - 1, n).cast("long")
    good = F.col("status").isin("succeeded", "partial") & F.col("provider_state").isin("ok", "empty")
    first = lambda value, when: F.min_by(value, F.when(F.col("__done") & F.coalesce(when, F.lit(False)), F.col("__k")))
    return kept.groupBy(key).agg(
        streak(F.col("status") == "failed").alias("failures"),
        streak(F.col("provider_state") == "throttled").alias("throttles"),
        streak(F.col("provider_state") == "empty").alias("empties"),
        first(F.col("__end"), good).alias("last_success_at"),
        F.max("__at").alias("last_attempt_at"),
        first(F.col("status"), F.lit(True)).alias("latest_status"),
        first(F.struct(F.col("__error").alias("message"), F.col("__end").alias("at")), F.coalesce(F.col("__error"), F.lit("")) != "").alias("latest_error"),
        F.count(F.lit(1)).alias("runs"),
    )


def recent_totals(runs: DataFrame, key: str, at: str, now: Column, minutes: int = 60) -> DataFrame:
    """For each key: runs started in the last ``minutes`` minutes and the sums of their counters."""
    since = runs.filter(F.unix_micros(F.col(at)) >= F.unix_micros(now) - minutes * 60_000_000)
    return since.groupBy(key).agg(F.count(F.lit(1)).alias("recent_runs"), *[F.sum(c).alias(f"recent_{c}") for c in ("returned", "accepted", "rejected", "inserted") if c in runs.columns])


def provider_health(providers: DataFrame, runs: DataFrame, key: str, at: str, now: Column) -> DataFrame:
    """Providers with state, reasons and alerts.

    The state is the first that holds of disabled, unknown, down, stale, degraded, healthy; alerts (code, severity) hold independently of
    it. providers: key, db_status (active, degraded, disabled or null), schedulable, stale_minutes, down_failures, degraded_empties (null: never),
    lag_files (null: no files), lag_degraded, lag_stale. runs: see leading_streaks, without test runs; a provider has at most 30 rows after it.
    """
    p = providers.join(leading_streaks(runs, key, at), key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    since = F.floor((F.unix_micros(now) - F.unix_micros("last_success_at")) / 60_000_000)
    off, closed, never = F.coalesce(F.col("db_status") == "disabled", F.lit(False)), ~F.col("schedulable"), zero("runs") == 0
    down = zero("failures") >= F.col("down_failures")
    quiet, lagging = since.isNull() | (since > F.col("stale_minutes")), F.coalesce(F.col("lag_files") >= F.col("lag_stale"), F.lit(False))
    weak = {
        "marked-degraded": F.col("db_status") == "degraded",
        "partial": F.col("latest_status") == "partial",
        "failures": zero("failures") >= 1,
        "throttles": zero("throttles") >= 1,
        "empties": (F.col("degraded_empties") > 0) & (zero("empties") >= F.col("degraded_empties")),
        "lag": F.col("lag_files") >= F.col("lag_degraded"),
    }
    named = lambda tests: F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))
    faults = named(weak)
    state = F.when(off | closed, "disabled").when(never, "unknown").when(down, "down").when(quiet | lagging, "stale").when(F.size(faults) > 0, "degraded").otherwise("healthy")
    p = p.withColumns({"state": state, "minutes_since_success": since})
    reasons = (
        F.when(off, F.array(F.lit("switched-off"))).when(closed, F.array(F.lit("not-schedulable"))).when(never, F.array(F.lit("never-run"))).when(down, F.array(F.lit("failures")))
        .when(quiet | lagging, named({"no-success": quiet, "lag": lagging})).when(F.size(faults) > 0, faults).otherwise(F.array(F.lit("recent-success")))
    )
    watched = ~off & F.col("schedulable")
    alerts = [
        ("provider-disabled", "info", off),
        ("provider-never-run", "info", ~off & ~closed & never),
        ("provider-down", "critical", F.col("state") == "down"),
        ("provider-stale", "critical", F.col("state") == "stale"),
        ("consecutive-failures", F.when(down, "critical").otherwise("warning"), watched & (zero("failures") >= 2)),
        ("consecutive-throttles", "warning", watched & (zero("throttles") >= 2)),
        ("gkg-file-lag", F.when(lagging, "critical").otherwise("warning"), watched & (F.col("lag_files") >= F.col("lag_degraded"))),
    ]
    rows = [F.when(when, F.struct(F.lit(code).alias("code"), (F.lit(level) if isinstance(level, str) else level).alias("severity"))) for code, level, when in alerts]
    return p.withColumns({"reasons": reasons, "alerts": F.array_compact(F.array(*rows))})


def overall_state(states: DataFrame) -> DataFrame:
    """The worst state of all."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("state"))
    return states.agg(F.element_at(F.array(*[F.lit(s) for s in STATES]), F.coalesce(F.max(rank), F.lit(2)).cast("int")).alias("state"))


def file_lag(expected: Column, available: Column, processed: Column) -> Column:
    """(steps, cause) behind the expected quarter-hour file: no-data, none, upstream-late or ingest-behind."""
    steps = F.greatest(F.lit(0), times.stamp_distance(expected, processed))
    cause = F.when(processed.isNull(), "no-data").when(steps == 0, "none").when(processed >= available, "upstream-late").otherwise("ingest-behind")
    return F.struct(steps.alias("steps"), cause.alias("cause"))


def stuck_runs(runs: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    return runs.filter((F.col("status") == "running") & (F.col("started_at") <= now - F.expr(f"INTERVAL {minutes} MINUTES")))


def schedulable(approved: Column, manual_only: Column, enabled: Column, configured: Column) -> Column:
    """Why a provider is not scheduled, or "scheduled"."""
    return F.when(~approved, "not-approved").when(manual_only, "manual-only").when(~enabled, "disabled").when(~configured, "not-configured").otherwise("scheduled")


STALE_MINUTES = 60


def _history(runs: DataFrame, now: Column) -> DataFrame:
    """One row on the runs that were no tests: the last success, the last run, and failures of the last 24 hours."""
    real = runs.filter("trigger <> 'test'")
    success = F.when(F.col("status") == "succeeded", F.struct("started_at", "run_id", F.coalesce("finished_at", "started_at").alias("at")))
    recent_failure = (F.col("status") == "failed") & (F.col("started_at") >= now - F.expr("INTERVAL 24 HOURS"))
    found = real.agg(F.max(success).alias("s"), F.max(F.struct("started_at", "run_id", "status", "error_message")).alias("l"), F.count_if(recent_failure).alias("failures_24h"))
    return found.select(F.col("s.at").alias("last_success_at"), F.col("l.started_at").alias("last_run_at"), F.col("l.status").alias("last_status"), F.col("l.error_message").alias("last_error"), "failures_24h")


def _side_by_side(*ones: DataFrame) -> DataFrame:
    """Tables of one row each as one row."""
    rows = ones[0]
    for other in ones[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def _alerts(failed: str, stale: str, is_stale: Column) -> Column:
    return F.array_compact(F.array(F.when(F.col("last_status") == "failed", failed), F.when(is_stale, stale)))


def _minutes_since_success(now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros("last_success_at")) / 6e7


def clustering_health(runs: DataFrame, unclustered: DataFrame, review: DataFrame, feed: DataFrame, now: Column) -> DataFrame:
    """One row: run history, reports of the last 24 hours without a cluster, near misses under review, live clusters, alerts.

    Stale: there are such reports and no success within STALE_MINUTES. Alerts are warnings: clusters are derived data.
    """
    waiting = unclustered.agg(F.count_if(F.col("fresh_at") >= now - F.expr("INTERVAL 24 HOURS")).alias("unclustered_recent"))
    row = _side_by_side(_history(runs, now), waiting, review.agg(F.count(F.lit(1)).alias("ambiguous_open")), feed.agg(F.count(F.lit(1)).alias("live_clusters")))
    late = F.coalesce(_minutes_since_success(now) >= STALE_MINUTES, F.lit(True))
    return row.withColumn("alerts", _alerts("clustering-failed", "clustering-stale", (F.col("unclustered_recent") > 0) & late))


def ranking_health(runs: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """One row: run history, whole minutes since the last success, ranked items to show or review, held and approved ones, alerts.

    Held: ineligible, held or rejected. Stale: the last success is STALE_MINUTES old; without any there is no such alert.
    """
    listed = F.col("rank").isNotNull() & F.col("eligibility").isin("eligible", "review")
    held = F.col("status").isin("held", "rejected") | (F.col("eligibility") == "ineligible")
    counts = items.agg(F.count_if(listed).alias("eligible_items"), F.count_if(held).alias("held_items"), F.count_if(F.col("status") == "approved").alias("approved_items"))
    row = _side_by_side(_history(runs, now), counts).withColumn("success_age_minutes", F.floor(_minutes_since_success(now)))
    return row.withColumn("alerts", _alerts("ranking-failed", "ranking-stale", F.col("success_age_minutes") >= STALE_MINUTES))
