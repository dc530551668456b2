"""Registered queries of the decision core: eligibility, scores, feeds, previews, runs and switches, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions import fixed, text, times
from tickerloom.operators import clustering, editorial, health, ingest_unit, joins, ranking, warehouse
from tickerloom.plans.queries import _CAND, _CLUSTERS, _LIST, _MEMBERS, _REASONS, _cand, _clusters, _judged, _members, query

_WHEN = "TIMESTAMP '2001-08-02'"


def _k():
    return F.col("k")


def _when():
    return F.lit("2001-08-02").cast("timestamp")


def _nth(words: list, at) -> Column:
    """The word at a position from 0; null for a missing one."""
    return F.element_at(F.array(*[F.lit(w) for w in words]), (at + 1).cast("int"))


def _orders(t) -> DataFrame:
    return t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderdate").cast("timestamp").alias("day"), "o_orderstatus", "o_orderpriority", "o_totalprice")


_ORDERS = "WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate::TIMESTAMP AS day, o_orderstatus, o_orderpriority, o_totalprice FROM orders)"

# --- ranking -------------------------------------------------------------------------------------------------------------


@query(
    _ORDERS
    + f""", x AS (SELECT k, list_filter([
  CASE WHEN k % 11 = 0 THEN 'closed-cluster' END, CASE WHEN k % 11 = 1 THEN 'needs-review-state' END, CASE WHEN k % 5 > 0 AND k % 3 = 0 THEN 'discovery-text-only' END,
  CASE WHEN NOT (k % 5 > 0 AND k % 3 = 0) AND k % 7 = 0 THEN 'no-publisher-headline' END, CASE WHEN k % 3 > 0 AND k % 2 * 2 >= k % 3 THEN 'betting-or-fantasy' END,
  CASE WHEN k % 13 = 0 THEN 'low-confidence' END, CASE WHEN k % 13 = 1 THEN 'medium-confidence' END, CASE WHEN k % 5 > 0 AND k % 4 = 0 THEN 'all-sources-disabled' END,
  CASE WHEN k % 4 > 0 AND k % 8 = 1 THEN 'all-sources-low-quality' END, CASE WHEN {_WHEN} - day > INTERVAL 48 HOURS AND k % 6 <> 0 THEN 'too-old' END,
  CASE WHEN k % 19 = 0 THEN 'unresolved-near-miss' END, CASE WHEN k % 17 = 0 THEN 'editor-rejected' END, CASE WHEN k % 17 = 1 THEN 'editor-held' END], lambda r: r IS NOT NULL) AS r FROM o)
SELECT k AS cluster_id, array_to_string(r, ',') AS reasons, CASE WHEN len(list_filter(r, lambda x: x NOT IN ('medium-confidence', 'unresolved-near-miss'))) > 0 THEN 'ineligible' WHEN len(r) > 0 THEN 'review' ELSE 'eligible' END AS state FROM x"""
)
def eligibility_reasons(t):
    """Every rule of eligibility with its state, over clusters in all combinations of signals."""
    c = _orders(t).select(
        _k().alias("cluster_id"), F.when(_k() % 11 == 0, "closed").when(_k() % 11 == 1, "needs_review").otherwise("active").alias("status"), (_k() % 5).alias("members"), (_k() % 3).alias("titles"), (_k() % 7 != 0).alias("headline_ok"),
        (_k() % 2).alias("betting"), F.when(_k() % 13 == 0, "low").when(_k() % 13 == 1, "medium").otherwise("high").alias("confidence"), (_k() % 4).alias("enabled_members"),
        F.when(_k() % 8 == 1, 0).otherwise(1).alias("better_members"), F.when(_k() % 6 != 0, F.col("day")).otherwise(_when()).alias("newest_at"), (_k() % 19 == 0).cast("int").alias("risky_near_misses"),
        F.when(_k() % 17 == 0, "rejected").when(_k() % 17 == 1, "held").otherwise("suggested").alias("item_status"),
    )
    return ranking.eligibility(c, _when()).select("cluster_id", F.array_join(F.transform("reasons", lambda r: r["code"]), ",").alias("reasons"), "state")


_SPORTS, _TIERS, _TYPES = ["basketball", "football", "golf", "unheard-of"], list(fixed.TIER_POINTS), ["trade", "injury", "game-result", "preview", "record"]
_CASES = lambda column, table, default: f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {default} END"
_CENTS = lambda x: f"round(({x})::DECIMAL(20, 8), 2)"
_SATURATED = lambda n, most: f"CASE WHEN {n} <= 1 THEN 0.0 ELSE least(1.0, ln({n}::DOUBLE) / ln({most}.0)) END"


@query(
    _ORDERS
    + f""", s AS (SELECT k, {_LIST(_SPORTS)}[(k % 4 + 1)::INT] AS sport, {_LIST(_TIERS)}[(k % {len(_TIERS)} + 1)::INT] AS tier, (k % 30)::DOUBLE AS lh, (k % 30 + k % 5)::DOUBLE AS eh, {_LIST(_TYPES)}[(c % 6 + 1)::INT] AS e,
  k % 4 = 1 AS stakes, ['normal', 'developing', 'breaking-candidate'][(k % 3 + 1)::INT] AS u, ['high', 'medium', 'low'][(c % 3 + 1)::INT] AS conf, c % 25 AS d, k % 9 AS v, k % 4 AS kd, k % 6 AS l15, k % 6 + c % 3 AS l60, c % 4 AS p FROM o),
f AS (SELECT *, {_CASES("coalesce(e, 'unknown')", fixed.EVENT_IMPORTANCE, fixed.EVENT_IMPORTANCE["unknown"])} AS imp, CASE e WHEN 'game-result' THEN 0.55 WHEN 'preview' THEN 0.4 ELSE 1.0 END AS bf, CASE e WHEN 'game-result' THEN 0.4 WHEN 'preview' THEN 0.3 ELSE 1.0 END AS vf FROM s),
g AS (SELECT *, [{_CASES("sport", fixed.SPORT_WEIGHT, 45)}, {_CASES("tier", fixed.TIER_POINTS, 0)}, {_CENTS("60 * (0.5 * pow(0.5, lh / 6.0) + 0.5 * pow(0.5, eh / 10.0))")},
  {_CENTS("CASE WHEN imp <= 0 THEN imp::DOUBLE ELSE imp * CASE WHEN d >= 3 THEN 1.0::DOUBLE WHEN d = 2 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END END")}, {_CENTS(f"34 * {_SATURATED('d', 20)} * bf::DOUBLE")}] AS always,
  [CASE WHEN stakes AND coalesce(e, '') <> 'preview' THEN 20 ELSE 0 END, {_CENTS(f"8 * {_SATURATED('v', 6)} * bf::DOUBLE")}, CASE WHEN kd >= 3 THEN 6 WHEN kd = 2 THEN 3 ELSE 0 END, least(2, greatest(0, p - 1)),
  {_CENTS("CASE WHEN d < 2 OR l60 = 0 THEN 0.0::DOUBLE ELSE (least(4, l15) * 5 + least(5, l60 - l15) * 2) * vf::DOUBLE END")}, CASE u WHEN 'developing' THEN 12 WHEN 'breaking-candidate' THEN 30 ELSE 0 END,
  CASE WHEN d <= 1 THEN -15 ELSE 0 END, CASE conf WHEN 'high' THEN 5 WHEN 'medium' THEN -25 ELSE 0 END] AS further FROM f)
SELECT k AS cluster_id, len(always) + len(list_filter(further, lambda x: x <> 0)) AS parts, (list_sum(always) + list_sum(further))::DOUBLE AS score FROM g"""
)
def score_breakdown(t):
    """The itemised score of clusters in all combinations of signals."""
    c = _orders(t).select(
        _k().alias("cluster_id"), _nth(_SPORTS, _k() % 4).alias("sport"), _nth(_TIERS, _k() % len(_TIERS)).alias("tier"), (_k() % 30).cast("double").alias("latest_hours"), (_k() % 30 + _k() % 5).cast("double").alias("event_hours"),
        F.get(F.array(*[F.lit(x) for x in _TYPES]), (F.col("c") % 6).cast("int")).alias("event_type"), (_k() % 4 == 1).alias("stakes"), _nth(["normal", "developing", "breaking-candidate"], _k() % 3).alias("urgency"),
        _nth(["high", "medium", "low"], F.col("c") % 3).alias("confidence"), (F.col("c") % 25).alias("domains"), (_k() % 9).alias("variants"), (_k() % 4).alias("known_domains"), (_k() % 6).alias("last_15m"),
        (_k() % 6 + F.col("c") % 3).alias("last_hour"), (F.col("c") % 4).alias("providers"), F.array().cast("array<struct<kind: string, amount: double>>").alias("overrides"),
    )
    return ranking.score_parts(c).select("cluster_id", F.size("parts").cast("long").alias("parts"), "score")


@query(
    _ORDERS
    + """SELECT k AS cluster_id, trim(coalesce(h, '')) <> '' AND state <> 'ineligible' AND status NOT IN ('held', 'rejected') AS may_approve
FROM (SELECT k, CASE WHEN k % 6 = 0 THEN NULL WHEN k % 6 = 1 THEN '  ' ELSE o_orderpriority END AS h, CASE k % 5 WHEN 0 THEN 'review' WHEN 1 THEN 'ineligible' ELSE 'eligible' END AS state, ['candidate', 'held', 'rejected', 'approved'][(c % 4 + 1)::INT] AS status FROM o)"""
)
def approvals(t):
    head = F.when(_k() % 6 == 0, F.lit(None)).when(_k() % 6 == 1, "  ").otherwise(F.col("o_orderpriority"))
    state = F.when(_k() % 5 == 0, "review").when(_k() % 5 == 1, "ineligible").otherwise("eligible")
    return _orders(t).select(_k().alias("cluster_id"), ranking.may_approve(head, state, _nth(["candidate", "held", "rejected", "approved"], F.col("c") % 4)).alias("may_approve"))


# --- clusters ------------------------------------------------------------------------------------------------------------


@query(
    """SELECT candidate_id, neighbour_id, similarity FROM (SELECT l_orderkey AS candidate_id, l_partkey AS neighbour_id, l_discount AS similarity,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber = 1 DESC, l_discount DESC, l_shipdate DESC, l_partkey) AS n FROM lineitem) WHERE n <= 3"""
)
def best_neighbours(t):
    pairs = t("lineitem").select(F.col("l_orderkey").alias("candidate_id"), F.col("l_partkey").alias("neighbour_id"), (F.col("l_linenumber") == 1).alias("exact"), F.col("l_discount").alias("similarity"), F.col("l_shipdate").alias("neighbour_fresh_at"))
    return joins.top_neighbours(pairs, 3).select("candidate_id", "neighbour_id", "similarity")


@query(
    _MEMBERS
    + """, p AS (SELECT cluster_id, l_partkey % 4 AS provider FROM m UNION SELECT cluster_id, l_suppkey % 6 AS provider FROM m WHERE l_linenumber % 2 = 0)
SELECT cluster_id, count(*) AS provider_count FROM p GROUP BY cluster_id"""
)
def cluster_providers(t):
    """Providers of each cluster over the members' own reports and all sightings."""
    m = _members(t)
    sightings = m.filter("l_linenumber % 2 = 0").select("candidate_id", (F.col("l_suppkey") % 6).alias("provider"))
    return clustering.provider_counts(m.withColumn("provider", F.col("l_partkey") % 4), sightings)


_RICH = """, r AS (SELECT *, 'report ' || l_partkey % 5 || CASE WHEN l_suppkey % 4 = 0 THEN ' ...' ELSE ' of the day in full' END AS headline, CASE WHEN l_partkey % 2 = 0 THEN 'publisher-title' ELSE 'discovery-text' END AS headline_kind,
  CASE WHEN l_suppkey % 3 <> 0 THEN fresh_at END AS published_at FROM m), rs AS (SELECT *, count(*) OVER (PARTITION BY cluster_id, source) AS share FROM r WHERE headline_kind = 'publisher-title'),
rep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY (length(headline) BETWEEN 20 AND 220 AND NOT contains(headline, '...')) DESC, enabled DESC, CASE quality WHEN 'known' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END DESC,
  CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 0 END DESC, published_at IS NOT NULL DESC, share, published_at NULLS LAST, candidate_id) AS n FROM rs) WHERE n = 1)"""


def _rich_members(t) -> DataFrame:
    ending = F.when(F.col("l_suppkey") % 4 == 0, " ...").otherwise(" of the day in full")
    return _members(t).withColumns(
        {
            "headline": F.concat(F.lit("report "), (F.col("l_partkey") % 5).cast("string"), ending),
            "headline_kind": F.when(F.col("l_partkey") % 2 == 0, "publisher-title").otherwise("discovery-text"),
            "published_at": F.when(F.col("l_suppkey") % 3 != 0, F.col("fresh_at")),
            "discovered_at": F.col("fresh_at"),
            "entities": F.array(F.concat(F.lit("team:"), (F.col("l_partkey") % 7).cast("string")), F.concat(F.lit("league:"), (F.col("l_suppkey") % 5).cast("string"))),
        }
    )


@query(
    _MEMBERS
    + _RICH
    + ", "
    + _CLUSTERS.strip().removeprefix("WITH ")
    + """, en AS (SELECT cluster_id, unnest(['team:' || l_partkey % 7, 'league:' || l_suppkey % 5]) AS e FROM m), es AS (SELECT cluster_id, string_agg(DISTINCT e, ',' ORDER BY e) AS entities FROM en GROUP BY cluster_id)
SELECT cl.cluster_id, status, rep.candidate_id AS representative_id, rep.headline, es.entities FROM cl LEFT JOIN rep USING (cluster_id) LEFT JOIN es USING (cluster_id) WHERE merged_into_id IS NULL AND cl.cluster_id % 37 <> 0"""
)
def cluster_feed(t):
    """Live clusters with representative and entities."""
    clusters = _clusters(t).withColumn("candidate_count", (F.col("cluster_id") % 37 != 0).cast("int"))
    feed = clustering.cluster_feed(clusters, _rich_members(t))
    return feed.select("cluster_id", "status", "representative_id", "headline", F.array_join("entities", ",").alias("entities"))


@query(
    _MEMBERS
    + """, near AS (SELECT candidate_id, cluster_id AS here, cluster_id + l_linenumber % 2 AS there FROM m WHERE l_suppkey % 5 = 0), side AS (SELECT here AS cluster_id, candidate_id FROM near UNION ALL SELECT there, candidate_id FROM near WHERE there <> here),
n AS (SELECT cluster_id, count(*) AS near_misses, string_agg(candidate_id::VARCHAR, ',' ORDER BY candidate_id) AS near_ids FROM side GROUP BY cluster_id),
mm AS (SELECT cluster_id, count(*) AS members, string_agg(candidate_id::VARCHAR, ',' ORDER BY candidate_id) AS member_ids FROM m GROUP BY cluster_id)
SELECT o_orderkey AS cluster_id, coalesce(members, 0) AS members, member_ids, coalesce(near_misses, 0) AS near_misses, near_ids FROM orders LEFT JOIN mm ON mm.cluster_id = o_orderkey LEFT JOIN n ON n.cluster_id = o_orderkey"""
)
def ranking_inputs(t):
    """Clusters with members and near misses nested."""
    m = _rich_members(t).withColumns({"domain": F.col("source"), "reported_at": F.col("fresh_at")})
    near = m.filter("l_suppkey % 5 = 0").select("candidate_id", F.col("cluster_id").alias("current_cluster_id"), (F.col("cluster_id") + F.col("l_linenumber") % 2).alias("suggested_cluster_id"), F.lit("close").alias("reason"))
    found = editorial.cluster_inputs(t("orders").select(F.col("o_orderkey").alias("cluster_id")), m, near)
    n = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long").alias(c)
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["candidate_id"].cast("string")), ",")
    return found.select("cluster_id", n("members"), ids("members").alias("member_ids"), n("near_misses"), ids("near_misses").alias("near_ids"))


# --- editors -------------------------------------------------------------------------------------------------------------


@query(
    """WITH l AS (SELECT o_custkey % 300 AS item_id, CASE o_orderkey % 3 WHEN 0 THEN 'pin' WHEN 1 THEN 'boost' ELSE 'suppress' END AS kind, o_orderdate AS created_at, o_orderkey AS override_id, CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS removed_at FROM orders),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, kind ORDER BY created_at DESC, override_id DESC) AS n FROM l) WHERE n = 1 AND removed_at IS NULL), s AS (SELECT item_id, string_agg(kind, ',' ORDER BY kind) AS kinds FROM a GROUP BY item_id)
SELECT p_partkey * 10 AS cluster_id, CASE WHEN p_size % 2 = 0 THEN 'held' ELSE 'suggested' END AS item_status, kinds FROM part LEFT JOIN s ON s.item_id = p_partkey"""
)
def editors_state(t):
    o = F.col("o_orderkey")
    log = t("orders").select(
        (F.col("o_custkey") % 300).alias("item_id"), F.when(o % 3 == 0, "pin").when(o % 3 == 1, "boost").otherwise("suppress").alias("kind"), o.cast("double").alias("amount"), F.lit("").alias("text"),
        F.col("o_orderdate").alias("created_at"), o.alias("override_id"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("removed_at"),
    )
    items = t("part").select((F.col("p_partkey") * 10).alias("cluster_id"), F.col("p_partkey").alias("item_id"), F.when(F.col("p_size") % 2 == 0, "held").otherwise("suggested").alias("status"))
    return editorial.editorial_state(items, log).select("cluster_id", "item_status", F.array_join(F.transform("overrides", lambda x: x["kind"]), ",").alias("kinds"))


@query(
    _ORDERS
    + """, i AS (SELECT k AS cluster_id, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 7 = 1 THEN ' ' ELSE '«' || o_orderpriority || '!» ' || k END AS h, CASE k % 5 WHEN 0 THEN 'ineligible' WHEN 1 THEN 'review' ELSE 'eligible' END AS eligibility,
  ['candidate', 'held', 'rejected', 'approved'][(c % 4 + 1)::INT] AS status, ['normal', 'developing', 'breaking-candidate'][(k % 3 + 1)::INT] AS urgency FROM o),
e AS (SELECT l_orderkey AS cluster_id, 's' || l_suppkey AS domain, l_linenumber = 2 AS rep, ['known', 'unknown', 'low-quality'][(l_suppkey % 3 + 1)::INT] AS quality, l_shipdate AS seen_at, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS id FROM lineitem WHERE l_partkey % 10 <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, domain ORDER BY rep DESC, seen_at, id) AS k FROM e),
s AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY rep DESC, CASE quality WHEN 'known' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END, seen_at, domain) AS nth FROM p WHERE k = 1),
a AS (SELECT cluster_id, string_agg(domain || ':' || quality, ',' ORDER BY nth) AS supporting, arg_min(domain, nth) FILTER (WHERE rep) AS attributed FROM s GROUP BY cluster_id)
SELECT i.cluster_id AS story_id, CASE urgency WHEN 'normal' THEN 'none' ELSE 'developing' END AS urgency, urgency = 'breaking-candidate' AS breaking_candidate, status = 'approved' AS ready, attributed, coalesce(supporting, '') AS supporting, 'deck,byline,image,articleBody,slug,credibilityTier' AS missing
FROM i LEFT JOIN a USING (cluster_id) WHERE trim(coalesce(h, '')) <> '' AND eligibility <> 'ineligible' AND status NOT IN ('held', 'rejected')"""
)
def story_previews(t):
    items = _orders(t).select(
        _k().alias("cluster_id"), F.when(_k() % 7 == 0, F.lit(None)).when(_k() % 7 == 1, " ").otherwise(F.concat(F.lit("«"), "o_orderpriority", F.lit("!» "), _k().cast("string"))).alias("headline"), F.lit("golf").alias("sport"),
        F.when(_k() % 5 == 0, "ineligible").when(_k() % 5 == 1, "review").otherwise("eligible").alias("eligibility"), _nth(["candidate", "held", "rejected", "approved"], F.col("c") % 4).alias("status"), _nth(["normal", "developing", "breaking-candidate"], _k() % 3).alias("urgency"),
    )
    m = _members(t).withColumns({"domain": F.col("source"), "publisher": F.upper("source"), "url": F.concat(F.lit("https://"), "source"), "is_representative": F.col("l_linenumber") == 2, "reported_at": F.col("fresh_at")})
    found = editorial.story_previews(items, ranking.supporting_sources(m))
    supporting = F.array_join(F.transform("supporting", lambda r: F.concat_ws(":", r["domain"], r["quality"])), ",")
    return found.select("story_id", "urgency", "breaking_candidate", "ready", F.col("attribution.domain").alias("attributed"), supporting.alias("supporting"), F.array_join("missing", ",").alias("missing"))


# --- providers and runs --------------------------------------------------------------------------------------------------


@query(
    """WITH s AS (SELECT n_name AS provider_key, 'old ' || n_name AS label, CASE WHEN n_nationkey % 4 = 0 THEN 'disabled' ELSE 'enabled' END AS status FROM nation WHERE n_nationkey < 15),
d AS (SELECT n_name AS provider_key, 'new ' || n_name AS label FROM nation WHERE n_nationkey >= 10 AND n_name IN ('INDIA', 'IRAN', 'JAPAN', 'RUSSIA', 'CHINA'))
SELECT coalesce(s.provider_key, d.provider_key) AS provider_key, coalesce(d.label, s.label) AS label, coalesce(s.status, 'enabled') AS status FROM s FULL JOIN d ON s.provider_key = d.provider_key"""
)
def provider_sync(t):
    n = t("nation")
    stored = n.filter("n_nationkey < 15").select(F.col("n_name").alias("provider_key"), F.concat(F.lit("old "), "n_name").alias("label"), F.when(F.col("n_nationkey") % 4 == 0, "disabled").otherwise("enabled").alias("status"))
    described = n.filter("n_nationkey >= 10").select(F.col("n_name").alias("provider_key"), F.concat(F.lit("new "), "n_name").alias("label"))
    return ingest_unit.sync_providers(stored, described, ["INDIA", "IRAN", "JAPAN", "RUSSIA", "CHINA"])


_RUNS = f"""{_ORDERS}, run AS (SELECT k AS run_id, c, CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'F' THEN 'failed' ELSE 'succeeded' END AS status, {_WHEN} - to_minutes((k % 61)::BIGINT) AS started_at,
  CASE WHEN o_orderstatus = 'F' THEN 'gone' END AS error_message FROM o)"""


def _runs(t) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "F", "failed").otherwise("succeeded")
    started = F.timestamp_micros((F.unix_micros(_when()) - (_k() % 61) * 60_000_000).cast("long"))
    return _orders(t).select(_k().alias("run_id"), "c", status.alias("status"), started.alias("started_at"), F.when(F.col("o_orderstatus") == "F", "gone").alias("error_message"), F.lit(None).cast("timestamp").alias("finished_at"))


@query(
    _RUNS
    + f"""SELECT run_id, CASE WHEN late THEN 'failed' ELSE status END AS status, CASE WHEN late THEN 'stale run reaped' ELSE error_message END AS error_message, CASE WHEN late THEN epoch_us({_WHEN}) END AS finished_at
FROM (SELECT *, status = 'running' AND started_at < {_WHEN} - INTERVAL 30 MINUTES AS late FROM run)"""
)
def stale_runs_reaped(t):
    return warehouse.reap_stale(_runs(t), _when()).select("run_id", "status", "error_message", F.unix_micros("finished_at").alias("finished_at"))


@query(_RUNS + f"SELECT run_id, epoch_us(started_at) AS started_at FROM run WHERE status = 'running' AND started_at <= {_WHEN} - INTERVAL 30 MINUTES")
def runs_stuck(t):
    return health.stuck_runs(_runs(t), _when()).select("run_id", F.unix_micros("started_at").alias("started_at"))


@query(
    _ORDERS
    + """SELECT k AS unit, CASE WHEN c % 4 IN (1, 2, 3) AND k % 3 = 0 THEN 'failed' WHEN k % 5 > 0 THEN 'partial' ELSE 'succeeded' END AS run_status, CASE WHEN c % 4 = 0 AND k % 5 > 0 AND k % 3 = 0 THEN 'error' ELSE ['ok', 'error', 'throttled', 'unavailable'][(c % 4 + 1)::INT] END AS feed_state,
CASE WHEN k % 2 = 0 THEN 'not-approved' WHEN c % 3 = 0 THEN 'manual-only' WHEN k % 7 = 0 THEN 'disabled' WHEN c % 5 = 0 THEN 'not-configured' ELSE 'scheduled' END AS schedule, CASE WHEN c % 3 = 1 THEN 'publisher-title' ELSE 'discovery-text' END AS headline_kind FROM o"""
)
def run_outcomes(t):
    c = F.col("c")
    state = _nth(["ok", "error", "throttled", "unavailable"], c % 4)
    return _orders(t).select(
        _k().alias("unit"), warehouse.run_status(state, _k() % 3, _k() % 5).alias("run_status"), ingest_unit.feed_state(state, _k() % 3, _k() % 5).alias("feed_state"),
        health.schedulable(_k() % 2 != 0, c % 3 == 0, _k() % 7 != 0, c % 5 != 0).alias("schedule"), ingest_unit.headline_kind((c % 3).cast("string"), ["1"]).alias("headline_kind"),
    )


_STATE_OF = "CASE WHEN n_regionkey = 0 THEN 'healthy' WHEN n_regionkey = 1 THEN 'disabled' WHEN n_regionkey = 2 THEN 'stale' ELSE 'unknown' END"


@query(f"SELECT {_LIST(health.STATES)}[max(list_position({_LIST(health.STATES)}, {_STATE_OF}))] AS state FROM nation")
def overall_health(t):
    r = F.col("n_regionkey")
    return health.overall_state(t("nation").select(F.when(r == 0, "healthy").when(r == 1, "disabled").when(r == 2, "stale").otherwise("unknown").alias("state")))


# --- text and times ------------------------------------------------------------------------------------------------------

_TITLE = "CASE k % 4 WHEN 0 THEN 'Two Lakers'' guards - not three - sign ' WHEN 1 THEN 'The Cubs’ star is Out for ' WHEN 2 THEN 'SEVEN teams and A 5-man group, ' ELSE 'Don''t ' END || o_orderpriority || CASE c % 3 WHEN 0 THEN ' | Some Daily News' WHEN 1 THEN ' – The Post' ELSE '' END"


@query(
    _ORDERS
    + rf""", h AS (SELECT k, {_TITLE} AS h FROM o), s AS (SELECT k, trim(regexp_replace(h, '{fixed.SOURCE_SUFFIX}', '')) AS s FROM h),
w AS (SELECT k, s, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(s), '[’'']s\b', '', 'g'), '[’'']', '', 'g'), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM s),
n AS (SELECT k, s, list_transform(w, lambda x: {_CASES("x", {k: f"'{v}'" for k, v in fixed.NUMBER_WORDS.items()}, "x")}) AS w FROM w)
SELECT k AS id, s AS headline, array_to_string(list_filter(w, lambda x: (length(x) > 1 OR regexp_matches(x, '^\d$')) AND NOT list_contains({_LIST(fixed.STOPWORDS)}, x)), ' ') AS tokens FROM n"""
)
def headline_words(t):
    """Headlines without the publisher, and their content words."""
    first = F.when(_k() % 4 == 0, "Two Lakers' guards - not three - sign ").when(_k() % 4 == 1, "The Cubs’ star is Out for ").when(_k() % 4 == 2, "SEVEN teams and A 5-man group, ").otherwise("Don't ")
    last = F.when(F.col("c") % 3 == 0, " | Some Daily News").when(F.col("c") % 3 == 1, " – The Post").otherwise("")
    h = _orders(t).select(_k().alias("id"), F.concat(first, "o_orderpriority", last).alias("h"))
    return h.select("id", text.strip_source_suffix(F.col("h")).alias("headline"), F.array_join(text.content_tokens(F.col("h"), ascii_only=True), " ").alias("tokens"))


@query(
    _ORDERS
    + """SELECT k AS id, '$' || CASE c % 4 WHEN 0 THEN k % 900 WHEN 1 THEN (k % 900) * 1000 WHEN 2 THEN (k % 900) * 1000000 + 500000 ELSE (k % 900) * 1000 + 7 END AS amount FROM o"""
)
def headline_amounts(t):
    """Dollar amounts in whole dollars, however written."""
    n = (_k() % 900).cast("string")
    worth = F.when(F.col("c") % 4 == 0, n).when(F.col("c") % 4 == 1, F.concat(n, F.lit("K"))).when(F.col("c") % 4 == 2, F.concat(n, F.lit(".5 million"))).otherwise(F.concat(n, F.lit(",007")))
    return _orders(t).select(_k().alias("id"), F.array_join(text.extract_amounts(F.concat(F.lit("Star signs $"), worth, F.lit(" deal"))), ",").alias("amount"))


@query(
    _CAND
    + f"""SELECT candidate_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN m // 60 || 'h ago' ELSE m // 1440 || 'd ago' END AS age
FROM (SELECT candidate_id, greatest(0, floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(fresh_at)) / 60000000.0))::BIGINT AS m FROM cand)"""
)
def relative_ages(t):
    return _cand(t).select("candidate_id", times.format_age(F.col("fresh_at"), F.lit("2024-01-31").cast("timestamp")).alias("age"))


@query(
    _ORDERS
    + """, s AS (SELECT k, CASE k % 5 WHEN 0 THEN '2001023' || (k % 10) || '101500' WHEN 1 THEN 'x' || k ELSE strftime(day, '%Y%m%d') || lpad((k % 24)::VARCHAR, 2, '0') || '4500' END AS stamp FROM o)
SELECT k AS id, epoch_us(try_strptime(stamp, '%Y%m%d%H%M%S')) AS at_us FROM s"""
)
def stamps_parsed(t):
    """Fourteen-digit stamps as times; what is no real time is null."""
    stamp = F.when(_k() % 5 == 0, F.concat(F.lit("2001023"), (_k() % 10).cast("string"), F.lit("101500"))).when(_k() % 5 == 1, F.concat(F.lit("x"), _k().cast("string")))
    stamp = stamp.otherwise(F.concat(F.date_format("day", "yyyyMMdd"), F.lpad((_k() % 24).cast("string"), 2, "0"), F.lit("4500")))
    return _orders(t).select(_k().alias("id"), F.unix_micros(times.parse_stamp(stamp)).alias("at_us"))


@query(
    _ORDERS
    + f"""SELECT k AS id, least(CASE WHEN a IS NULL OR a IN ('game-result', 'record') THEN 12 ELSE 24 END, CASE WHEN b IS NULL OR b IN ('game-result', 'record') THEN 12 ELSE 24 END)::BIGINT AS hours
FROM (SELECT k, {_LIST(_TYPES)}[(k % 6 + 1)::INT] AS a, {_LIST(_TYPES)}[(c % 6 + 1)::INT] AS b FROM o)"""
)
def pair_windows(t):
    """Hours that reports of one event may lie apart, by both event types."""
    kind = lambda at: F.get(F.array(*[F.lit(x) for x in _TYPES]), (at % 6).cast("int"))
    return _orders(t).select(_k().alias("id"), times.fuzzy_window_hours(kind(_k()), kind(F.col("c"))).cast("long").alias("hours"))


@query(_ORDERS + "SELECT k AS id, epoch_us(day - to_minutes((15 * n)::BIGINT)) AS stamp FROM o, range(0, 4) r(n)")
def recent_files(t):
    """The four quarter-hour files up to a time."""
    rows = _orders(t).select(_k().alias("id"), F.explode(times.recent_stamps(F.col("day"), 4)).alias("s"))
    return rows.select("id", F.unix_micros("s").alias("stamp"))


# --- health and reports ---------------------------------------------------------------------------------------------------

_HISTORY = (
    _RUNS
    + f""", real AS (SELECT *, CASE WHEN c % 3 = 0 THEN started_at + INTERVAL 1 MINUTE END AS finished_at FROM run WHERE c % 5 > 0),
h AS (SELECT (SELECT coalesce(finished_at, started_at) FROM real WHERE status = 'succeeded' ORDER BY started_at DESC, run_id DESC LIMIT 1) AS ok,
  (SELECT status FROM real ORDER BY started_at DESC, run_id DESC LIMIT 1) AS last_status, (SELECT count(*) FROM real WHERE status = 'failed' AND started_at >= {_WHEN} - INTERVAL 24 HOURS) AS failures_24h)"""
)


def _told_runs(t) -> DataFrame:
    ended = F.when(F.col("c") % 3 == 0, F.col("started_at") + F.expr("INTERVAL 1 MINUTE"))
    return _runs(t).withColumns({"finished_at": ended, "trigger": F.when(F.col("c") % 5 == 0, "test").otherwise("schedule")})


@query(
    _HISTORY
    + f""", u AS (SELECT count(*) AS n FROM o WHERE k % 3 > 0 AND day >= {_WHEN} - INTERVAL 24 HOURS), f AS (SELECT count(*) AS n FROM o WHERE k % 3 = 0), r AS (SELECT count(*) AS n FROM o WHERE o_orderstatus = 'P')
SELECT epoch_us(ok) AS last_success_at, last_status, failures_24h, u.n AS unclustered_recent, r.n AS ambiguous_open, f.n AS live_clusters,
  array_to_string(list_filter([CASE WHEN last_status = 'failed' THEN 'clustering-failed' END, CASE WHEN u.n > 0 AND coalesce(epoch_us({_WHEN}) - epoch_us(ok) >= 3600000000, true) THEN 'clustering-stale' END], lambda x: x IS NOT NULL), ',') AS alerts
FROM h, u, f, r"""
)
def clusters_health(t):
    o = _orders(t)
    row = health.clustering_health(_told_runs(t), o.filter("k % 3 > 0").withColumn("fresh_at", F.col("day")), o.filter("o_orderstatus = 'P'"), o.filter("k % 3 = 0"), _when())
    return row.select(F.unix_micros("last_success_at").alias("last_success_at"), "last_status", "failures_24h", "unclustered_recent", "ambiguous_open", "live_clusters", F.array_join("alerts", ",").alias("alerts"))


@query(
    _HISTORY
    + f""", i AS (SELECT CASE WHEN k % 6 > 0 THEN k END AS rank, ['eligible', 'review', 'ineligible'][(k % 3 + 1)::INT] AS eligibility, ['suggested', 'approved', 'held', 'rejected'][(c % 4 + 1)::INT] AS status FROM o),
n AS (SELECT count(*) FILTER (WHERE rank IS NOT NULL AND eligibility IN ('eligible', 'review')) AS eligible_items, count(*) FILTER (WHERE status IN ('held', 'rejected') OR eligibility = 'ineligible') AS held_items, count(*) FILTER (WHERE status = 'approved') AS approved_items FROM i)
SELECT last_status, failures_24h, (epoch_us({_WHEN}) - epoch_us(ok)) // 60000000 AS success_age_minutes, eligible_items, held_items, approved_items,
  array_to_string(list_filter([CASE WHEN last_status = 'failed' THEN 'ranking-failed' END, CASE WHEN epoch_us({_WHEN}) - epoch_us(ok) >= 3600000000 THEN 'ranking-stale' END], lambda x: x IS NOT NULL), ',') AS alerts FROM h, n"""
)
def rankings_health(t):
    items = _orders(t).select(F.when(_k() % 6 > 0, _k()).alias("rank"), _nth(["eligible", "review", "ineligible"], _k() % 3).alias("eligibility"), _nth(["suggested", "approved", "held", "rejected"], F.col("c") % 4).alias("status"))
    row = health.ranking_health(_told_runs(t), items, _when())
    return row.select("last_status", "failures_24h", "success_age_minutes", "eligible_items", "held_items", "approved_items", F.array_join("alerts", ",").alias("alerts"))


@query(
    _REASONS
    + """, run AS (SELECT o_orderstatus AS status FROM orders), src AS (SELECT DISTINCT source FROM documents)
SELECT 'new_recent' AS metric, NULL AS key, count(*) FILTER (WHERE discovered_at >= TIMESTAMP '2024-01-02')::DOUBLE AS value FROM cand UNION ALL SELECT 'observations', NULL, count(*)::DOUBLE FROM events
UNION ALL SELECT 'sources', NULL, count(*)::DOUBLE FROM src UNION ALL SELECT 'disabled_sources', NULL, (count(*) FILTER (WHERE source IN ('src3', 'src7')))::DOUBLE FROM src
UNION ALL SELECT 'rejections', NULL, (count(*) FILTER (WHERE len(reasons) > 0))::DOUBLE FROM r UNION ALL SELECT 'by_reason', reason, count(*)::DOUBLE FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY reason
UNION ALL SELECT 'runs_by_status', status, count(*)::DOUBLE FROM run GROUP BY status UNION ALL SELECT 'by_quality', confidence, count(*)::DOUBLE FROM cand GROUP BY confidence"""
)
def warehouse_details(t):
    sources = t("documents").select("source").distinct().withColumn("enabled", ~F.col("source").isin("src3", "src7"))
    rejected = _judged(t).filter(F.size("reasons") > 0)
    return warehouse.warehouse_report(_cand(t).withColumn("quality", F.col("confidence")), t("events"), sources, rejected, t("orders").withColumnRenamed("o_orderstatus", "status"), F.lit("2024-01-02").cast("timestamp"))


@query(
    _CAND
    + """SELECT normalized_headline, headline_kind, count(DISTINCT source) AS source_count, count(*) AS candidate_count FROM cand GROUP BY normalized_headline, headline_kind HAVING count(*) > 1
ORDER BY source_count DESC, candidate_count DESC, normalized_headline, headline_kind LIMIT 5"""
)
def top_headline_groups(t):
    return warehouse.top_groups(_cand(t)).select("normalized_headline", "headline_kind", "source_count", "candidate_count")


@query(_RUNS + "SELECT run_id, status, epoch_us(started_at) AS started_at FROM run ORDER BY run.started_at DESC, run_id DESC LIMIT 1")
def newest_run(t):
    return warehouse.latest_run(_runs(t)).select("run_id", "status", F.unix_micros("started_at").alias("started_at"))
