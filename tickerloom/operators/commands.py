"""Editors' commands as whole tables: each command is judged by the state that all before it leave, and every outcome is an audit row.

Commands of one key are ordered by (at, command_id). What a command meets follows from the last commands of a kind before it, so
windows replace a loop; a key with many commands is streamed, never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.operators.clustering import cluster_aggregates, representatives
from tickerloom.storage import discard, written

#: Statuses that an editor may set, kinds of overrides, the largest boost and suppression, and the usual suppression.
STATUSES = ["candidate", "review", "approved", "held", "rejected"]
KINDS = ["pin", "boost", "suppress", "force_section", "force_priority"]
MOST_BOOST, MOST_SUPPRESS, USUAL_SUPPRESS = 300, 1000, 300


def _before(*key: str) -> Window:
    return Window.partitionBy(*key).orderBy("at", "command_id").rowsBetween(Window.unboundedPreceding, -1)


def set_statuses(items: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items after all commands, and the audit: command_id, item_id, outcome, status_from, status_to, refusal.

    items: item_id, headline, eligibility, status. commands: command_id, at, item_id, status. Outcomes: changed, unchanged, refused
    (unknown-item, unknown-status, no-headline, ineligible: also if held or rejected). Any valid status but "approved" always takes
    effect; "approved" does if the item may be approved and is neither held nor rejected at that point.
    """
    held = items.select("item_id", "headline", "eligibility", F.col("status").alias("__first"), F.lit(True).alias("__known"))
    c = commands.select("command_id", "at", "item_id", "status").join(held, "item_id", "left")
    known, valid = F.coalesce("__known", F.lit(False)), F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))
    titled = F.trim(F.coalesce("headline", F.lit(""))) != ""
    may = titled & (F.coalesce("eligibility", F.lit("")) != "ineligible")
    approving = F.col("status") == "approved"
    c = c.withColumn("__nth", F.row_number().over(Window.partitionBy("item_id").orderBy("at", "command_id")))
    w = _before("item_id")
    plain = F.last(F.when(known & valid & ~approving, F.struct("status", "__nth")), ignorenulls=True).over(w)
    tried = F.last(F.when(known & valid & approving & may, F.col("__nth")), ignorenulls=True).over(w)
    base = F.coalesce(F.col("__plain.status"), F.col("__first"))
    shut = base.isin("held", "rejected")
    current = F.when(~shut & (F.col("__tried") > F.coalesce(F.col("__plain.__nth"), F.lit(0))), "approved").otherwise(base)
    c = c.withColumns({"__plain": plain, "__tried": tried}).withColumn("status_from", F.when(known, current))
    refusal = (
        F.when(~valid, "unknown-status").when(~known, "unknown-item").when(approving & ~titled, "no-headline")
        .when(approving & (~may | F.col("status_from").isin("held", "rejected")), "ineligible")
    )
    c = c.withColumn("refusal", refusal)
    outcome = F.when(F.col("refusal").isNotNull(), "refused").when(F.col("status_from") == F.col("status"), "unchanged").otherwise("changed")
    audit = written(c.withColumn("outcome", outcome).select("command_id", "at", "item_id", "outcome", "status_from", F.col("status").alias("status_to"), "refusal"))
    final = audit.filter("outcome <> 'refused'").groupBy("item_id").agg(F.max_by("status_to", F.struct("at", "command_id")).alias("__now"))
    after = items.join(final, "item_id", "left").withColumn("status", F.coalesce("__now", "status")).drop("__now")
    return after.select(*items.columns), audit.drop("at")


def set_overrides(items: DataFrame, log: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The override log after all commands, and the audit: command_id, item_id, outcome, ids, refusal.

    log: override_id, item_id, kind, amount, text, created_at, removed_at, removed_reason. commands: command_id, at, item_id, action (set or
    remove), kind (null with remove: all kinds), amount, text, reason. A set closes the standing override of its item and kind as
    "superseded" and opens one numbered by its command_id; a remove closes standing ones with its reason, else "removed". Audit: set
    (ids: what it superseded), removed (ids: what it closed), nothing-removed, refused (unknown-item, unknown-kind, unknown-action,
    amount). Commands must be later than the standing overrides.
    """
    c = commands.select("command_id", "at", "item_id", "action", "kind", "amount", "text", "reason").join(items.select("item_id", F.lit(True).alias("__known")), "item_id", "left")
    amount = F.col("amount")
    wrong = F.when(F.col("kind") == "boost", ~F.coalesce((amount > 0) & (amount <= MOST_BOOST), F.lit(False))).when(F.col("kind") == "suppress", amount.isNotNull() & ~((amount > 0) & (amount <= MOST_SUPPRESS))).otherwise(F.lit(False))
    setting, removing = F.coalesce(F.col("action") == "set", F.lit(False)), F.coalesce(F.col("action") == "remove", F.lit(False))
    every = removing & F.col("kind").isNull()
    refusal = (
        F.when(~setting & ~removing, "unknown-action").when(F.col("__known").isNull(), "unknown-item")
        .when(~every & ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown-kind").when(setting & wrong, "amount")
    )
    c = written(c.withColumn("refusal", refusal).drop("__known"))
    kinds = F.explode(F.when(F.col("kind").isNull(), F.array(*[F.lit(k) for k in KINDS])).otherwise(F.array("kind"))).alias("kind")
    acts = c.filter("refusal is null").select("command_id", "at", "item_id", kinds, F.when(F.col("action") == "set", F.col("command_id")).alias("override_id"), "action", F.when((F.col("kind") == "suppress") & F.col("amount").isNull(), USUAL_SUPPRESS).otherwise(F.col("amount")).alias("amount"), "text", "reason")
    standing = log.filter("removed_at is null")
    opened = standing.select(F.lit(None).cast(acts.schema["command_id"].dataType).alias("command_id"), F.col("created_at").alias("at"), "item_id", "kind", "override_id", F.lit("set").alias("action"), "amount", "text", F.lit(None).cast("string").alias("reason"))
    both = opened.unionByName(acts)
    order = Window.partitionBy("item_id", "kind").orderBy(F.col("command_id").isNotNull(), "at", "command_id", "override_id")
    nxt = lambda c: F.lead(c).over(order)
    both = written(
        both.withColumns(
            {
                "removed_at": nxt("at"), "next_action": nxt("action"), "next_reason": nxt("reason"),
                "closes": F.lag("override_id").over(order),  # null after a remove: nothing stands then
            }
        )
    )
    removed = F.when(F.col("next_action") == "set", "superseded").when(F.col("next_action") == "remove", F.coalesce("next_reason", F.lit("removed")))
    rows = both.filter("action = 'set'").select("override_id", "item_id", "kind", "amount", "text", F.col("at").alias("created_at"), "removed_at", removed.alias("removed_reason"))
    after = log.filter("removed_at is not null").select(*rows.columns).unionByName(rows)
    ids = both.filter("command_id is not null").groupBy("command_id").agg(F.array_sort(F.collect_list("closes")).alias("ids"))  # an id a kind at most
    audit = c.join(ids, "command_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<long>")))
    outcome = F.when(F.col("refusal").isNotNull(), "refused").when(F.col("action") == "set", "set").when(F.size("ids") > 0, "removed").otherwise("nothing-removed")
    return after, audit.select("command_id", "item_id", outcome.alias("outcome"), "ids", "refusal")


def set_switches(rows: DataFrame, commands: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """A table of keys after the last command to each (command_id, at, key, value), and the audit: command_id, key, outcome; an
    unknown key is refused."""
    known = rows.select(key, F.col(column).alias("__first"), F.lit(True).alias("__known"))
    c = commands.select("command_id", "at", key, "value").join(known, key, "left")
    met = F.coalesce(F.last("value").over(_before(key)), F.col("__first"))
    outcome = F.when(F.col("__known").isNull(), "unknown-key").when(met.eqNullSafe(F.col("value")), "unchanged").otherwise("changed")
    last = commands.groupBy(key).agg(F.max_by("value", F.struct("at", "command_id")).alias("__now"), F.lit(True).alias("__set"))
    after = rows.join(last, key, "left").withColumn(column, F.when(F.col("__set"), F.col("__now")).otherwise(F.col(column))).select(*rows.columns)
    return after, c.select("command_id", key, outcome.alias("outcome"))


# --- merges and moves of clusters ------------------------------------------------------------------------------------------


def judge_merges(clusters: DataFrame, merges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """Merges (command_id, at, from_id, into_id) with refusal: missing, self, unknown, or merged-away if by then either side was merged into another.

    clusters: cluster_id, merged_into_id. Whether one is accepted depends on accepted earlier ones that fold one of its clusters away. All
    are judged at once by the round before; the first that differ from a walk in order are right one round later.
    """
    state = clusters.select(F.col("cluster_id").alias("__id"), F.col("merged_into_id").isNotNull().alias("__gone"))
    m = merges.select("command_id", "at", "from_id", "into_id")
    for side in ("from", "into"):
        m = m.join(state.withColumnsRenamed({"__id": f"{side}_id", "__gone": f"__{side}"}), f"{side}_id", "left")
    early = (
        F.when(F.col("from_id").isNull() | F.col("into_id").isNull(), "missing").when(F.col("from_id") == F.col("into_id"), "self")
        .when(F.col("__from").isNull() | F.col("__into").isNull(), "unknown").when(F.col("__from") | F.col("__into"), "merged-away")
    )
    m = written(m.select("command_id", "at", "from_id", "into_id", early.alias("early")))
    accepted = written(m.filter("early is null").select("command_id", "at", "from_id"))
    for _ in range(most_rounds):
        # The first accepted fold of each cluster; of several accepted by mistake the first is the one that may stand.
        folds = accepted.groupBy(F.col("from_id").alias("__id")).agg(F.min(F.struct("at", "command_id")).alias("__when"))
        judged = m.filter("early is null")
        for side in ("from", "into"):
            judged = judged.join(folds.withColumnsRenamed({"__id": f"{side}_id", "__when": f"__{side}"}), f"{side}_id", "left")
        me = F.struct("at", "command_id")
        blocked = F.coalesce(F.col("__from") < me, F.lit(False)) | F.coalesce(F.col("__into") < me, F.lit(False))
        now = written(judged.filter(~blocked).select("command_id", "at", "from_id"))
        same = now.select("command_id").join(accepted, "command_id", "left_anti").isEmpty() and accepted.select("command_id").join(now, "command_id", "left_anti").isEmpty()
        discard(accepted)
        accepted = now
        if same:
            done = accepted.select("command_id", F.lit(True).alias("__ok"))
            return m.join(done, "command_id", "left").select("command_id", "at", "from_id", "into_id", F.when(F.col("early").isNotNull(), F.col("early")).when(F.col("__ok").isNull(), "merged-away").alias("refusal"))
    raise RuntimeError("merges did not settle")


def merge_ends(folds: DataFrame, most: int = 64) -> DataFrame:
    """(from_id, end_id, path) of accepted folds (from_id, into_id, at, command_id), followed to their ends; each round doubles the steps.

    path: the commands on the way, the last first. Of two clusters' contents, those with the smaller path were earlier where they met.
    """
    current = written(folds.select("from_id", F.col("into_id").alias("end_id"), F.array(F.struct("at", "command_id")).alias("path")))
    for _ in range(most):
        step = current.select(F.col("from_id").alias("end_id"), F.col("end_id").alias("__next"), F.col("path").alias("__path"))
        if current.join(step, "end_id", "left_semi").isEmpty():
            return current
        path = F.when(F.col("__next").isNull(), F.col("path")).otherwise(F.concat("__path", "path"))
        longer = written(current.join(step, "end_id", "left").select("from_id", F.coalesce("__next", "end_id").alias("end_id"), path.alias("path")))
        discard(current)
        current = longer
    raise RuntimeError("merges go round in a circle")


def merge_stored(clusters: DataFrame, members: DataFrame, near_misses: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(clusters, members, near_misses, audit) after merges of stored clusters, by the change alone.

    clusters: cluster_id, status, merged_into_id and aggregates, all or some of recomputed's. members: candidate_id, cluster_id and what aggregates need.
    near_misses: candidate_id, cluster_id, score. merges and audit: see judge_merges. Members of merged clusters move to the end of their
    chain. Only clusters touched are recomputed, from their members alone; all others keep their rows. The folded cluster closes with
    counts 0; a stable or closed survivor opens. A near miss follows its cluster; where two meet, the one that was there first
    stays, and none stays whose candidate is in that cluster.
    """
    audit = written(judge_merges(clusters, merges))
    folds = audit.filter("refusal is null").select("from_id", "into_id", "at", "command_id")
    target = written(merge_ends(folds))
    to = target.select(F.col("from_id").alias("cluster_id"), F.col("end_id").alias("__end"), F.col("path").alias("__path"))
    moved = members.join(to.drop("__path"), "cluster_id", "left").withColumn("merged_from_id", F.when(F.col("__end").isNotNull(), F.col("cluster_id")))
    moved = moved.withColumn("cluster_id", F.coalesce("__end", "cluster_id")).drop("__end")
    touched = written(target.select(F.explode(F.array("from_id", "end_id")).alias("cluster_id")).distinct())
    first = F.coalesce("__path", F.array().cast(target.schema["path"].dataType))
    ends = near_misses.join(to, "cluster_id", "left").select("candidate_id", F.coalesce("__end", "cluster_id").alias("cluster_id"), "score", first.alias("__path"))
    one = ends.groupBy("candidate_id", "cluster_id").agg(F.min_by("score", "__path").alias("score"))
    own = moved.join(touched, "cluster_id", "left_semi").select("candidate_id", "cluster_id")
    near = one.join(own, ["candidate_id", "cluster_id"], "left_anti")
    c = _swapped(clusters, moved, touched).join(folds.select(F.col("from_id").alias("cluster_id"), F.col("into_id").alias("__into")), "cluster_id", "left")
    opens = F.col("__some") & F.col("status").isin("stable", "closed")
    status = F.when(F.col("__emptied"), "closed").when(opens, "open").otherwise(F.col("status"))
    after = c.withColumns({"status": status, "merged_into_id": F.coalesce("__into", "merged_into_id")})
    return after.select(*clusters.columns), moved, near, audit


def _swapped(clusters: DataFrame, members: DataFrame, touched: DataFrame) -> DataFrame:
    """Clusters with new aggregates where touched, and __some and __emptied: whether a touched one has members. One without keeps
    what describes it, but for counts, representative and headline."""
    fresh = recomputed(members.join(touched, "cluster_id", "left_semi"))
    aggregates = [x for x in fresh.columns if x != "cluster_id" and x in clusters.columns]
    marked = touched.withColumn("__touched", F.lit(True))
    new = fresh.select("cluster_id", F.lit(True).alias("__new"), *[F.col(x).alias(f"__{x}") for x in aggregates])
    c = clusters.join(marked, "cluster_id", "left").join(new, "cluster_id", "left")
    some, hit = F.col("__new").isNotNull(), F.col("__touched").isNotNull()
    empty = {x: F.lit(0) if x in ("candidate_count", "source_count") else F.lit(None) if x in ("representative_id", "headline") else F.col(x) for x in aggregates}
    values = {x: F.when(some, F.col(f"__{x}")).when(hit, empty[x]).otherwise(F.col(x)).cast(clusters.schema[x].dataType) for x in aggregates}
    return c.withColumns({"__some": some, "__emptied": hit & ~some} | values)


def recomputed(members: DataFrame) -> DataFrame:
    """Aggregates and representative of the clusters that these members make up."""
    best = representatives(members).withColumnRenamed("candidate_id", "representative_id")
    return cluster_aggregates(members).join(best, "cluster_id", "left")


def move_stored(clusters: DataFrame, members: DataFrame, near_misses: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(clusters, members, near_misses, audit) after editors' moves (command_id, at, candidate_id, to_cluster), by the change alone.

    A move is refused if its candidate is in no cluster, its destination unknown or merged away; it does nothing where the candidate
    already is. The last one counts; method becomes manual and moved_from names the cluster left. Clusters left and entered are recomputed;
    one without members closes with counts 0. A near miss that pointed to the new cluster is settled.
    """
    at = members.select("candidate_id", F.col("cluster_id").alias("__first"))
    state = clusters.select(F.col("cluster_id").alias("to_cluster"), F.col("merged_into_id").isNotNull().alias("__gone"))
    c = moves.select("command_id", "at", "candidate_id", "to_cluster").join(at, "candidate_id", "left").join(state, "to_cluster", "left")
    refusal = F.when(F.col("__first").isNull(), "not-clustered").when(F.col("__gone").isNull(), "unknown-cluster").when(F.col("__gone"), "merged-away")
    c = c.withColumn("refusal", refusal)
    here = F.coalesce(F.last(F.when(F.col("refusal").isNull(), F.col("to_cluster")), ignorenulls=True).over(_before("candidate_id")), F.col("__first"))
    c = c.withColumn("from_cluster", here)
    outcome = F.when(F.col("refusal").isNotNull(), "refused").when(F.col("from_cluster") == F.col("to_cluster"), "already-there").otherwise("moved")
    audit = written(c.withColumn("outcome", outcome).select("command_id", "at", "candidate_id", "from_cluster", "to_cluster", "outcome", "refusal"))
    done = audit.filter("outcome = 'moved'")
    last = written(done.groupBy("candidate_id").agg(F.max_by(F.struct("from_cluster", "to_cluster"), F.struct("at", "command_id")).alias("m")))
    moved = members.join(last, "candidate_id", "left").withColumns({"moved_from": F.col("m.from_cluster"), "method": F.when(F.col("m").isNotNull(), "manual").otherwise(F.col("method")), "cluster_id": F.coalesce("m.to_cluster", "cluster_id")}).drop("m")
    settled = done.select("candidate_id", F.col("to_cluster").alias("cluster_id")).distinct()
    near = near_misses.join(settled, ["candidate_id", "cluster_id"], "left_anti")
    touched = written(done.select(F.explode(F.array("from_cluster", "to_cluster")).alias("cluster_id")).distinct())
    after = _swapped(clusters, moved, touched)
    return after.withColumn("status", F.when(F.col("__emptied"), "closed").otherwise(F.col("status"))).select(*clusters.columns), moved, near, audit
