"""Editors' commands, merges and moves as tables against loops, one command after the other."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tickerloom.operators import commands

START = dt.datetime(2024, 1, 1)
at = lambda k: START + dt.timedelta(minutes=k)


def shuffled(rng, rows):
    rng.shuffle(rows)
    return rows


def test_statuses_match_a_loop(spark):
    rng = random.Random(1)
    items = {i: [rng.choice(["a headline", " ", None]) if i % 3 == 0 else "h", rng.choice(["eligible", "review", "ineligible"]), rng.choice(["candidate", "review", "held", "approved"])] for i in range(20)}
    orders = [(k, at(rng.randrange(90)), rng.choice([*items, 99]), rng.choice([*commands.STATUSES, "approved", "approved", "published", None])) for k in range(300)]
    states, audit = {i: v[2] for i, v in items.items()}, {}
    for k, _, i, status in sorted(orders, key=lambda o: (o[1], o[0])):
        was = states.get(i)
        head, eligibility = items[i][:2] if i in items else (None, None)
        if status not in commands.STATUSES:
            audit[k] = ("refused", was, "unknown-status")
        elif i not in items:
            audit[k] = ("refused", None, "unknown-item")
        elif status == "approved" and not (head or "").strip():
            audit[k] = ("refused", was, "no-headline")
        elif status == "approved" and (eligibility == "ineligible" or was in ("held", "rejected")):
            audit[k] = ("refused", was, "ineligible")
        else:
            audit[k] = ("unchanged" if was == status else "changed", was, None)
            states[i] = status
    table = spark.createDataFrame([(i, *v) for i, v in items.items()], "item_id long, headline string, eligibility string, status string")
    after, found = commands.set_statuses(table, spark.createDataFrame(shuffled(rng, orders), "command_id long, at timestamp, item_id long, status string"))
    assert {r.command_id: (r.outcome, r.status_from, r.refusal) for r in found.collect()} == audit
    assert {r.item_id: r.status for r in after.collect()} == states
    assert {a[2] for a in audit.values()} == {None, "unknown-status", "unknown-item", "no-headline", "ineligible"} and ("changed", "review", None) in audit.values()


def test_overrides_match_a_loop(spark):
    rng = random.Random(2)
    log = [(1000 + i, i % 6, commands.KINDS[i % 5], 5.0, "t", at(-10), None if i % 4 else at(-5), None if i % 4 else "old") for i in range(12)]
    standing = {(r[1], r[2]): list(r) for r in log if r[6] is None}
    log = [r for r in log if r[6] is not None] + [tuple(r) for r in standing.values()]
    kinds = [*commands.KINDS, "boost", "suppress", "loud", None]
    orders = [(k, at(rng.randrange(60)), rng.choice([0, 1, 2, 3, 4, 5, 77]), rng.choice(["set", "set", "remove", "shout"]), rng.choice(kinds), rng.choice([None, 0.0, 5.0, 300.0, 301.0, 1001.0]), "x", rng.choice([None, "why"])) for k in range(250)]
    rows, audit = [list(r) for r in log], {}
    active = {(r[1], r[2]): r for r in rows if r[6] is None}
    for k, when, item, action, kind, amount, words, reason in sorted(orders, key=lambda o: (o[1], o[0])):
        bad = action == "set" and ((kind == "boost" and not (amount and 0 < amount <= 300)) or (kind == "suppress" and amount is not None and not 0 < amount <= 1000))
        everything = action == "remove" and kind is None
        if action == "shout" or item == 77 or (not everything and kind not in commands.KINDS) or bad:
            audit[k] = ("refused", [], "unknown-action" if action == "shout" else "unknown-item" if item == 77 else "unknown-kind" if not everything and kind not in commands.KINDS else "amount")
            continue
        closed = []
        for one in commands.KINDS if everything else [kind]:
            if old := active.pop((item, one), None):
                old[6:] = [when, "superseded" if action == "set" else reason or "removed"]
                closed.append(old[0])
        if action == "set":
            rows.append([k, item, kind, 300.0 if kind == "suppress" and amount is None else amount, words, when, None, None])
            active[item, kind] = rows[-1]
        audit[k] = ("set" if action == "set" else "removed" if closed else "nothing-removed", sorted(closed), None)
    schema = "override_id long, item_id long, kind string, amount double, text string, created_at timestamp, removed_at timestamp, removed_reason string"
    items = spark.createDataFrame([(i,) for i in range(6)], "item_id long")
    after, found = commands.set_overrides(items, spark.createDataFrame(log, schema), spark.createDataFrame(shuffled(rng, orders), "command_id long, at timestamp, item_id long, action string, kind string, amount double, text string, reason string"))
    assert {r.command_id: (r.outcome, r.ids, r.refusal) for r in found.collect()} == audit
    assert sorted(map(tuple, after.collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_switches(spark):
    rows = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "domain string, enabled boolean")
    orders = spark.createDataFrame([(1, at(1), "a", False), (2, at(2), "a", False), (3, at(3), "a", True), (4, at(1), "zz", True), (5, at(1), "b", True)], "command_id long, at timestamp, domain string, value boolean")
    after, audit = commands.set_switches(rows, orders, "domain", "enabled")
    assert {tuple(r) for r in after.collect()} == {("a", True), ("b", True), ("c", True)}
    assert [r.outcome for r in audit.orderBy("command_id").collect()] == ["changed", "unchanged", "changed", "unknown-key", "changed"]


MEMBER = "candidate_id long, cluster_id long, source string, headline string, headline_kind string, enabled boolean, quality string, confidence string, sport string, league string, event_type string, published_at timestamp, discovered_at timestamp, method string"


def world(spark, seed, n=60, clusters=16):
    rng = random.Random(seed)
    pick = rng.choice
    rows = [
        (i, rng.randrange(clusters - 2), f"s{rng.randrange(9)}", pick(["a headline of some length", "short", "another headline that is long", "cut off headline of a page ..."]), pick(["publisher-title"] * 3 + ["discovery-text"]), rng.random() < 0.8,
         pick(["known", "unknown", "low-quality"]), pick(["high", "medium", "low"]), pick(["golf", "boxing", None]), pick(["l1", "l2", None]), pick(["trade", "injury", None]), pick([None, at(rng.randrange(99))]), at(rng.randrange(99)), "seed")
        for i in range(n)
    ]
    members = spark.createDataFrame(rows, MEMBER)
    state = spark.createDataFrame([(i, pick(["open", "stable", "closed"]), 3 if i == clusters - 1 else None) for i in range(clusters)], "cluster_id long, status string, merged_into_id long")
    made = state.join(commands.recomputed(members), "cluster_id", "left").fillna(0, ["candidate_count", "source_count"])
    near = [(i, c, round(rng.random(), 3)) for i in range(n) for c in rng.sample(range(clusters), 4) if c != rows[i][1]]
    return rng, rows, members, made, near


def check_clusters(clusters, after, moved, statuses, merged, touched):
    """All clusters equal a full recompute of the members, untouched ones their old rows."""
    old, new = ({r.cluster_id: r.asDict() for r in df.collect()} for df in (clusters, after))
    fresh = {r.cluster_id: r.asDict() for r in commands.recomputed(moved).collect()}
    for c, row in new.items():
        want = dict(old[c]) if c not in touched else old[c] | {"candidate_count": 0, "source_count": 0, "representative_id": None, "headline": None} | fresh.get(c, {})
        assert row == want | {"status": statuses[c], "merged_into_id": merged.get(c)}, c


def test_merges_match_a_loop(spark):
    for seed in (1, 2):
        rng, rows, members, clusters, near = world(spark, seed)
        orders = [(k, at(rng.randrange(40)), rng.choice([*range(16), None, 88]), rng.choice([*range(16), 88])) for k in range(24)]
        first = {r.cluster_id: r for r in clusters.collect()}
        statuses, merged = {c: r.status for c, r in first.items()}, {c: r.merged_into_id for c, r in first.items()}
        place = {r[0]: r[1] for r in rows}
        misses, audit, touched = {(i, c): s for i, c, s in near}, {}, set()
        for k, _, a, b in sorted(orders, key=lambda o: (o[1], o[0])):
            why = "missing" if a is None or b is None else "self" if a == b else "unknown" if a not in first or b not in first else "merged-away" if merged[a] is not None or merged[b] is not None else None
            audit[k] = why
            if why:
                continue
            merged[a] = b
            place = {i: b if c == a else c for i, c in place.items()}
            for (i, c), s in list(misses.items()):
                if c == a:
                    del misses[i, c]
                    misses.setdefault((i, b), s)
            for (i, c) in [m for m in misses if m[1] == b and place[m[0]] == b]:
                del misses[i, c]
            statuses[a] = "closed"
            statuses[b] = "closed" if b not in place.values() else "open" if statuses[b] in ("stable", "closed") else statuses[b]
            touched |= {a, b}
        for c in touched:  # a survivor that was only between two others
            if merged[c] is not None:
                statuses[c] = "closed"
        table = spark.createDataFrame(near, "candidate_id long, cluster_id long, score double")
        after, moved, kept, found = commands.merge_stored(clusters, members, table, spark.createDataFrame(orders, "command_id long, at timestamp, from_id long, into_id long"))
        assert {r.command_id: r.refusal for r in found.collect()} == audit
        assert {r.candidate_id: r.cluster_id for r in moved.collect()} == place
        assert {(r.candidate_id, r.cluster_id): r.score for r in kept.collect()} == misses
        check_clusters(clusters, after, moved, statuses, merged, touched)
        assert None in audit.values() and len(set(audit.values())) >= 4


def test_moves_match_a_loop(spark):
    rng, rows, members, clusters, near = world(spark, 5, n=30)
    orders = [(k, at(rng.randrange(40)), rng.choice([*range(30), 500]), rng.choice([*range(16), 88])) for k in range(60)]
    first = {r.cluster_id: r for r in clusters.collect()}
    place, misses, audit, touched = {r[0]: r[1] for r in rows}, {(i, c): s for i, c, s in near}, {}, set()
    for k, _, i, to in sorted(orders, key=lambda o: (o[1], o[0])):
        why = "not-clustered" if i not in place else "unknown-cluster" if to not in first else "merged-away" if first[to].merged_into_id is not None else None
        audit[k] = (why or ("already-there" if place[i] == to else "moved"), place.get(i))
        if not why and place[i] != to:
            touched |= {place[i], to}
            place[i] = to
            misses.pop((i, to), None)
    statuses = {c: "closed" if c in touched and c not in place.values() else r.status for c, r in first.items()}
    after, moved, kept, found = commands.move_stored(clusters, members, spark.createDataFrame(near, "candidate_id long, cluster_id long, score double"), spark.createDataFrame(orders, "command_id long, at timestamp, candidate_id long, to_cluster long"))
    assert {r.command_id: (r.refusal or r.outcome, r.from_cluster) for r in found.collect()} == audit
    assert {r.candidate_id: r.cluster_id for r in moved.collect()} == place
    assert {r.candidate_id for r in moved.filter("method = 'manual'").collect()} == {i for i, c in place.items() if any(a[0] == "moved" for k, a in audit.items() for o in orders if o[0] == k and o[2] == i)}
    assert {(r.candidate_id, r.cluster_id): r.score for r in kept.collect()} == misses
    check_clusters(clusters, after, moved, statuses, {c: r.merged_into_id for c, r in first.items()}, touched)


def test_only_members_of_touched_clusters_are_recomputed(spark):
    _, _, members, clusters, near = world(spark, 7)
    after, *_ = commands.merge_stored(clusters, members, spark.createDataFrame(near, "candidate_id long, cluster_id long, score double"), spark.createDataFrame([(1, at(1), 2, 3)], "command_id long, at timestamp, from_id long, into_id long"))
    assert "LeftSemi" in after._jdf.queryExecution().optimizedPlan().toString()
    assert after.filter("cluster_id = 2").select("status", "merged_into_id", "candidate_count").first() == ("closed", 3, 0)
    assert after.select(F.sum("candidate_count")).first()[0] == 60
