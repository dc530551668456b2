"""Registered queries of editors' commands, merges and moves, each with DuckDB SQL that walks the commands one by one where they depend on each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.operators import clustering, commands
from tickerloom.plans.queries import _CLUSTERS, _MEMBERS, _clusters, _members, query

# Parts are editorial items, orders commands to them.

_ITEMS = """items AS (SELECT p_partkey AS item_id, CASE p_size % 5 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE p_name END AS headline, ['eligible', 'review', 'ineligible'][(p_partkey % 3 + 1)::INT] AS eligibility,
  ['candidate', 'review', 'held', 'approved'][(p_partkey % 4 + 1)::INT] AS status FROM part)"""
_STATUS = (
    f"""WITH RECURSIVE {_ITEMS},
c AS (SELECT o_orderkey AS command_id, CASE WHEN o_orderkey % 50 = 0 THEN -1 ELSE o_custkey END AS item_id, ['candidate', 'review', 'approved', 'held', 'rejected', 'approved', 'published'][(o_orderkey % 7 + 1)::INT] AS wanted, o_orderdate AS seen FROM orders),
k AS (SELECT c.*, row_number() OVER (PARTITION BY c.item_id ORDER BY seen, command_id) AS n, i.item_id IS NOT NULL AS known, trim(coalesce(i.headline, '')) <> '' AS titled, i.eligibility FROM c LEFT JOIN items i USING (item_id)),
w AS (SELECT item_id, 0::BIGINT AS n, NULL::BIGINT AS command_id, status, NULL::VARCHAR AS status_from, NULL::VARCHAR AS refusal, NULL::VARCHAR AS wanted FROM items UNION ALL
  SELECT item_id, n, command_id, CASE WHEN refused IS NULL THEN wanted ELSE was END, was, refused, wanted FROM (SELECT k.item_id, k.n, k.command_id, k.wanted, w.status AS was, CASE WHEN k.wanted = 'published' THEN 'unknown-status' WHEN k.wanted = 'approved' AND NOT titled THEN 'no-headline'
    WHEN k.wanted = 'approved' AND (k.eligibility = 'ineligible' OR w.status IN ('held', 'rejected')) THEN 'ineligible' END AS refused FROM w JOIN k ON k.item_id = w.item_id AND k.n = w.n + 1))
"""
)


def _items(t) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size") % 5
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (n + 1).cast("int"))
    head = F.when(size == 0, " ").when(size == 1, F.lit(None)).otherwise(F.col("p_name"))
    return t("part").select(k.alias("item_id"), head.alias("headline"), pick(["eligible", "review", "ineligible"], k % 3).alias("eligibility"), pick(["candidate", "review", "held", "approved"], k % 4).alias("status"))


def _status_commands(t) -> tuple[DataFrame, DataFrame]:
    o = F.col("o_orderkey")
    words = F.array(*[F.lit(w) for w in ("candidate", "review", "approved", "held", "rejected", "approved", "published")])
    c = t("orders").select(o.alias("command_id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.when(o % 50 == 0, F.lit(-1).cast("long")).otherwise(F.col("o_custkey")).alias("item_id"), F.element_at(words, (o % 7 + 1).cast("int")).alias("status"))
    return commands.set_statuses(_items(t), c)


@query(
    _STATUS
    + """SELECT command_id, item_id, CASE WHEN refusal IS NOT NULL THEN 'refused' WHEN status_from = wanted THEN 'unchanged' ELSE 'changed' END AS outcome, status_from, wanted AS status_to, refusal FROM w WHERE n > 0
UNION ALL SELECT command_id, item_id, 'refused', NULL, wanted, CASE WHEN wanted = 'published' THEN 'unknown-status' ELSE 'unknown-item' END FROM k WHERE NOT known"""
)
def status_commands(t):
    """The audit of all status commands."""
    return _status_commands(t)[1]


@query(_STATUS + "SELECT item_id, arg_max(status, n) AS status FROM w GROUP BY item_id")
def status_items(t):
    """Items after all status commands."""
    return _status_commands(t)[0].select("item_id", "status")


_OVERRIDES = (
    f"""WITH {_ITEMS},
c AS (SELECT o_orderkey AS command_id, o_orderdate AS seen, CASE WHEN o_orderkey % 50 = 0 THEN -1 ELSE o_custkey END AS item_id, CASE WHEN o_orderkey % 4 = 0 THEN 'remove' WHEN o_orderkey % 97 = 0 THEN 'shout' ELSE 'set' END AS action,
  ['pin', 'boost', 'suppress', 'force_section', 'force_priority', 'loud', NULL][(o_custkey % 7 + 1)::INT] AS kind, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 400)::DOUBLE END AS amount FROM orders),
j AS (SELECT c.*, CASE WHEN action = 'shout' THEN 'unknown-action' WHEN i.item_id IS NULL THEN 'unknown-item' WHEN coalesce(kind = 'loud', action = 'set') THEN 'unknown-kind'
  WHEN action = 'set' AND kind = 'boost' AND NOT coalesce(amount > 0 AND amount <= 300, false) THEN 'amount' WHEN action = 'set' AND kind = 'suppress' AND amount IS NOT NULL AND NOT (amount > 0 AND amount <= 1000) THEN 'amount' END AS refusal
  FROM c LEFT JOIN items i USING (item_id)),
x AS (SELECT command_id, seen, item_id, action, amount, unnest(CASE WHEN kind IS NULL THEN ['pin', 'boost', 'suppress', 'force_section', 'force_priority'] ELSE [kind] END) AS kind FROM j WHERE refusal IS NULL),
s AS (SELECT a.*, (SELECT arg_min((b.seen, b.action), (b.seen, b.command_id)) FROM x b WHERE b.item_id = a.item_id AND b.kind = a.kind AND (b.seen, b.command_id) > (a.seen, a.command_id)) AS nxt,
  (SELECT arg_min(b.command_id, (b.seen, b.command_id)) FROM x b WHERE b.item_id = a.item_id AND b.kind = a.kind AND (b.seen, b.command_id) > (a.seen, a.command_id)) AS closer FROM x a WHERE action = 'set')
"""
)


def _override_commands(t) -> tuple[DataFrame, DataFrame]:
    o = F.col("o_orderkey")
    kinds = F.array(*[F.lit(k) for k in (*commands.KINDS, "loud", None)])
    action = F.when(o % 4 == 0, "remove").when(o % 97 == 0, "shout").otherwise("set")
    c = t("orders").select(
        o.alias("command_id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.when(o % 50 == 0, F.lit(-1).cast("long")).otherwise(F.col("o_custkey")).alias("item_id"), action.alias("action"),
        F.element_at(kinds, (F.col("o_custkey") % 7 + 1).cast("int")).alias("kind"), F.when(o % 3 > 0, (o % 400).cast("double")).alias("amount"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("reason"),
    )
    log = c.limit(0).select(F.col("command_id").alias("override_id"), "item_id", "kind", "amount", "text", F.col("at").alias("created_at"), F.col("at").alias("removed_at"), F.col("reason").alias("removed_reason"))
    return commands.set_overrides(_items(t), log, c)


@query(
    _OVERRIDES
    + """SELECT j.command_id, j.item_id, CASE WHEN refusal IS NOT NULL THEN 'refused' WHEN j.action = 'set' THEN 'set' WHEN count(s.command_id) > 0 THEN 'removed' ELSE 'nothing-removed' END AS outcome, coalesce(string_agg(s.command_id::VARCHAR, ',' ORDER BY s.command_id), '') AS ids, refusal
FROM j LEFT JOIN s ON s.closer = j.command_id GROUP BY j.command_id, j.item_id, j.action, refusal"""
)
def override_commands(t):
    """The audit of all override commands."""
    audit = _override_commands(t)[1]
    return audit.withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ","))


@query(_OVERRIDES + "SELECT command_id AS override_id, item_id, kind, CASE WHEN kind = 'suppress' THEN coalesce(amount, 300) ELSE amount END AS amount, epoch_us(nxt[1]) AS removed_at, CASE nxt[2] WHEN 'set' THEN 'superseded' WHEN 'remove' THEN 'removed' END AS removed_reason FROM s")
def override_log(t):
    """The log of overrides after all commands."""
    return _override_commands(t)[0].select("override_id", "item_id", "kind", "amount", F.unix_micros("removed_at").alias("removed_at"), "removed_reason")


@query(
    """WITH c AS (SELECT o_orderkey AS command_id, o_orderdate AS seen, CASE WHEN o_orderkey % 50 = 0 THEN -1 ELSE o_custkey % 120 END AS source, o_orderstatus = 'F' AS value FROM orders),
k AS (SELECT c.*, s_suppkey IS NOT NULL AS known, coalesce(lag(value) OVER (PARTITION BY source ORDER BY seen, command_id), s_suppkey % 5 <> 0) AS met FROM c LEFT JOIN supplier ON s_suppkey = source)
SELECT command_id, source, CASE WHEN NOT known THEN 'unknown-key' WHEN met = value THEN 'unchanged' ELSE 'changed' END AS outcome FROM k"""
)
def source_switches(t):
    """The audit of switches of sources."""
    o = F.col("o_orderkey")
    rows = t("supplier").select(F.col("s_suppkey").alias("source"), (F.col("s_suppkey") % 5 != 0).alias("enabled"))
    c = t("orders").select(o.alias("command_id"), F.col("o_orderdate").cast("timestamp").alias("at"), F.when(o % 50 == 0, F.lit(-1).cast("long")).otherwise(F.col("o_custkey") % 120).alias("source"), (F.col("o_orderstatus") == "F").alias("value"))
    return commands.set_switches(rows, c, "source", "enabled")[1]


@query(
    """WITH RECURSIVE c AS (SELECT s_suppkey AS command_id, row_number() OVER (ORDER BY round(s_acctbal * 100)::BIGINT, s_suppkey) AS n, CASE WHEN s_suppkey % 31 <> 0 THEN s_suppkey % 40 END AS from_id, s_suppkey * 7 % 45 AS into_id FROM supplier),
w AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS command_id, [39::BIGINT] AS gone, NULL::VARCHAR AS refusal UNION ALL SELECT n, command_id, CASE WHEN refusal IS NULL THEN list_append(gone, from_id) ELSE gone END, refusal FROM
  (SELECT c.n, c.command_id, w.gone, c.from_id, CASE WHEN from_id IS NULL THEN 'missing' WHEN from_id = into_id THEN 'self' WHEN into_id >= 40 THEN 'unknown' WHEN list_contains(w.gone, from_id) OR list_contains(w.gone, into_id) THEN 'merged-away' END AS refusal FROM w JOIN c ON c.n = w.n + 1))
SELECT command_id, refusal FROM w WHERE n > 0"""
)
def merge_commands(t):
    """Which merges are refused, and why; suppliers as commands between forty clusters, of which one was merged before."""
    k = F.col("s_suppkey")
    ids = t("supplier").sparkSession.range(40).select(F.col("id").alias("cluster_id"), F.when(F.col("id") == 39, 3).cast("long").alias("merged_into_id"))
    at = F.timestamp_micros(F.round(F.col("s_acctbal") * 100).cast("long") + 10**12)
    c = t("supplier").select(k.alias("command_id"), at.alias("at"), F.when(k % 31 != 0, k % 40).alias("from_id"), (k * 7 % 45).alias("into_id"))
    return commands.judge_merges(ids, c).select("command_id", "refusal")


_MERGED = (
    _MEMBERS
    + ", "
    + _CLUSTERS.strip().removeprefix("WITH ")
    + """, f AS (SELECT a.cluster_id AS from_id, b.cluster_id AS into_id FROM cl a JOIN cl b ON b.cluster_id = a.cluster_id + 1 WHERE a.cluster_id % 20 = 7 AND a.merged_into_id IS NULL AND b.merged_into_id IS NULL),
mm AS (SELECT coalesce(f.into_id, m.cluster_id) AS cluster_id, source FROM m LEFT JOIN f ON f.from_id = m.cluster_id), n AS (SELECT cluster_id, count(*) AS candidate_count, count(DISTINCT source) AS source_count FROM mm GROUP BY cluster_id)
SELECT cl.cluster_id, CASE WHEN f.from_id IS NOT NULL THEN 'closed' WHEN i.into_id IS NOT NULL AND n.cluster_id IS NULL THEN 'closed' WHEN i.into_id IS NOT NULL AND status IN ('stable', 'closed') THEN 'open' ELSE status END AS status, coalesce(f.into_id, merged_into_id) AS merged_into_id,
  coalesce(candidate_count, 0) AS candidate_count, coalesce(source_count, 0) AS source_count FROM cl LEFT JOIN f ON f.from_id = cl.cluster_id LEFT JOIN f i ON i.into_id = cl.cluster_id LEFT JOIN n ON n.cluster_id = cl.cluster_id"""
)


@query(_MERGED)
def merged_clusters(t):
    """Clusters after editors' merges; only those touched are recomputed."""
    m = _members(t).withColumns(
        {"discovered_at": F.col("fresh_at"), "published_at": F.col("fresh_at"), "sport": F.lit("golf"), "league": F.lit(None).cast("string"), "headline": F.concat(F.lit("report number "), F.col("l_partkey").cast("string")), "headline_kind": F.lit("publisher-title")}
    )
    counts = clustering.cluster_aggregates(m).select("cluster_id", "candidate_count", "source_count")  # what the stored table keeps
    stored = _clusters(t).drop("last_seen_at").join(counts, "cluster_id", "left").fillna(0, ["candidate_count", "source_count"])
    o = F.col("o_orderkey")
    c = t("orders").filter(o % 20 == 7).select(o.alias("command_id"), F.col("o_orderdate").cast("timestamp").alias("at"), o.alias("from_id"), (o + 1).alias("into_id"))
    near = m.select("candidate_id", (F.col("cluster_id") + 1).alias("cluster_id"), F.lit(0.5).alias("score"))
    return commands.merge_stored(stored, m, near, c)[0].select("cluster_id", "status", "merged_into_id", "candidate_count", "source_count")
