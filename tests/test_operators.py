"""Order-dependent operators against plain sequential versions; sources; streams."""

import datetime as dt
import hashlib
import io
import random
import re
import zipfile
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickerloom.functions import fixed
from tickerloom.operators import clustering, health, ranking, slate, warehouse
from tickerloom.sources import gkg, json_feeds, wikitext
from tickerloom.streaming import ingest


def test_ingest_batch_matches_a_loop(spark):
    rng = random.Random(3)
    rows = [(i, f"u{rng.randrange(12)}", 1, f"i{rng.randrange(9)}" if rng.random() < 0.7 else None, f"h{rng.randrange(6)}") for i in range(60)]
    schema = "candidate_id long, normalized_url string, provider long, provider_item_id string, normalized_headline string"
    stored = spark.createDataFrame([(900, "u1", 1, "i2", "h0")], schema)
    got = {r.candidate_id for r in warehouse.ingest_batch(spark.createDataFrame(rows, schema), stored).filter("inserted").collect()}
    urls, items, want = {"u1"}, {"i2"}, set()
    for i, url, _, item, _ in sorted(rows, key=lambda r: (r[4], r[1], r[0])):
        if url not in urls and (item is None or item not in items):
            want.add(i)
            urls.add(url)
            items |= {item} - {None}
    assert got == want


def test_components_of_long_chains(spark):
    turned = [0, *range(99, 0, -1)]  # the least id far from the next
    for order in (list(range(100)), turned):
        edges = spark.createDataFrame(list(zip(order, order[1:])), "candidate_id long, neighbour_id long")
        got = clustering.components(edges, spark.range(101).withColumnRenamed("id", "candidate_id")).collect()
        assert {(r.candidate_id, r.component) for r in got} == {(i, 0) for i in range(100)} | {(100, 100)}
    with pytest.raises(RuntimeError):
        clustering.components(edges, spark.range(101).withColumnRenamed("id", "candidate_id"), most_rounds=1)


def test_rows_without_item_never_meet(spark):
    schema = "candidate_id long, normalized_url string, provider long, provider_item_id string, normalized_headline string"
    rows = spark.createDataFrame([(i, f"u{i % 40}", 1, None, "") for i in range(60)], schema)
    out = warehouse.ingest_batch(rows, spark.createDataFrame([(900, "u1", 1, "i2", "h0")], schema))
    assert "windowspecdefinition(__item" not in out._jdf.queryExecution().analyzed().toString()
    assert {r.candidate_id for r in out.filter("inserted").collect()} == set(range(40)) - {1}


def test_ingest_batch_items_matches_a_loop(spark):
    from tickerloom.plans import queries as plans

    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    pages = plans._normalized_pages(read).filter("normalized is not null").collect()
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    item = lambda r: md5(re.sub(r"^[a-z]+://[^/]+", "", r.normalized)) if r.page_id % 5 else None
    old = [r for r in pages if r.page_id % 3 == 0]
    urls, items, want, by_item = {r.normalized for r in old}, {item(r) for r in old} - {None}, set(), 0
    for r in sorted((r for r in pages if r.page_id % 3), key=lambda r: (md5(f"h{r.page_id}"), r.normalized, r.page_id)):
        by_item += r.normalized not in urls and item(r) in items
        if r.normalized not in urls and item(r) not in items:
            want.add(r.page_id)
            urls.add(r.normalized)
            items |= {item(r)} - {None}
    assert {r.candidate_id for r in plans.queries()["ingest_batch_items"](spark, "/root/testdata/sf0.001").filter("inserted").collect()} == want
    assert by_item


def test_ingest_batch_of_a_long_chain(spark):
    rows = [(2 * i + k, f"u{i + k:03}", 1, f"i{i:03}", f"h{(37 * (2 * i + k)) % 211:03}") for i in range(100) for k in (0, 1)]
    schema = "candidate_id long, normalized_url string, provider long, provider_item_id string, normalized_headline string"
    got = {r.candidate_id for r in warehouse.ingest_batch(spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)).filter("inserted").collect()}
    urls, items, want = set(), set(), set()
    for i, url, _, item, _ in sorted(rows, key=lambda r: (r[4], r[1], r[0])):
        if url not in urls and item not in items:
            want.add(i)
            urls.add(url)
            items.add(item)
    assert got == want


def test_merge_chain_and_moves(spark):
    m = spark.createDataFrame([(1, 1, "seed"), (2, 2, "seed"), (3, 3, "seed")], "candidate_id long, cluster_id long, method string")
    merges = spark.createDataFrame([(1, 2), (2, 3)], "from_id long, into_id long")
    assert {r.cluster_id for r in clustering.merge_clusters(m, merges).collect()} == {3}
    moved = clustering.move_members(m, spark.createDataFrame([(2, 9)], "candidate_id long, to_cluster long"))
    assert {(r.candidate_id, r.cluster_id, r.method) for r in moved.collect()} == {(1, 1, "seed"), (2, 9, "manual"), (3, 3, "seed")}


def test_long_merge_chains_and_circles(spark):
    m = spark.createDataFrame([(i, i) for i in range(45)], "candidate_id long, cluster_id long")
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(44, 44)], "from_id long, into_id long")
    got = {r.candidate_id: r.cluster_id for r in clustering.merge_clusters(m, chain).collect()}
    assert got == {i: 40 if i <= 40 else i for i in range(45)}
    with pytest.raises(ValueError, match="circle"):
        clustering.merge_clusters(m, spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "from_id long, into_id long"))


def item(i, **over):
    base = dict(cluster_id=i, edition="e", headline=f"h{i}", state="eligible", item_status="candidate", score=200.0 - i, sport="basketball", desk="run", event_type="trade", urgency="normal", domains=3, lead_ok=True, wire_ok=True, now_ok=True, desk_ok=True, entities=[f"team:{i}"], tokens=[f"t{i}"], teams=[f"{i}"], newest_at=pd.Timestamp("2024-01-01"), pinned=False, forced_section=None)  # fmt: skip  # noqa: C408
    return base | over


def test_slate_rules():
    items = pd.DataFrame([item(i) for i in range(12)] + [item(50, entities=["team:0", "team:x"], tokens=["t0"], score=150.0, sport="basketball")])
    rows = slate.fill_sections(items)
    placed = [(s, p, c) for s, p, c, skip in rows if skip is None]
    assert placed[0] == ("lead", 1, 0)
    assert sum(s == "wire" for s, _, _ in placed) == 3  # two fifths of six, rounded up
    assert len({c for _, _, c in placed}) == len(placed)
    assert (None, 50, "same-event") in [(p, c, skip) for _, p, c, skip in rows]
    pinned = slate.fill_sections(pd.DataFrame([item(1), item(2, pinned=True, forced_section="wire")]))
    assert ("wire", 1, 2, None) in pinned


def test_slates_keep_their_limits():
    rng = random.Random(5)
    for _ in range(20):
        drawn = [
            item(
                i, score=float(rng.randrange(120, 260)), sport=rng.choice(["basketball", "football", "golf"]), desk=rng.choice(["run", "huddle", "across-the-board"]), event_type=rng.choice(["trade", "injury", None]),
                teams=sorted({str(rng.randrange(8)) for _ in range(rng.randrange(3))}), entities=[f"e{rng.randrange(40)}" for _ in range(2)], tokens=[f"t{rng.randrange(60)}"], lead_ok=rng.random() < 0.3, wire_ok=rng.random() < 0.5,
                now_ok=rng.random() < 0.7, desk_ok=rng.random() < 0.9, urgency=rng.choice(["normal", "developing"]), domains=rng.randrange(1, 5), newest_at=rng.choice([pd.NaT, pd.Timestamp("2024-01-01")]),
            )
            for i in range(rng.choice([0, 3, 80]))
        ]
        rows = slate.fill_sections(pd.DataFrame(drawn, columns=list(item(0))))
        by_id = {r["cluster_id"]: r for r in drawn}
        placed = [(s, by_id[c]) for s, _, c, why in rows if why is None]
        assert len({r["cluster_id"] for _, r in placed}) == len(placed)
        assert all(why in (None, "same-event", "team", "sport", "event-type") for *_, why in rows)
        for section in slate.SECTIONS:
            here = [r for s, r in placed if s == section]
            assert len(here) <= fixed.SLATE_DEPTH[section] and all(r[f"{section}_ok"] if f"{section}_ok" in r else r["desk"] == section and r["desk_ok"] for r in here)
            assert [p for s, p, _, why in rows if s == section and why is None] == list(range(1, len(here) + 1))
            assert max(Counter(t for r in here for t in r["teams"]).values(), default=0) <= fixed.DIVERSITY["team_section"]
        assert max(Counter(t for _, r in placed for t in r["teams"]).values(), default=0) <= fixed.DIVERSITY["team_slate"]


def test_scores_add_up(spark):
    row = spark.createDataFrame([(1, "basketball", "professional", 2.0, 2.0, "trade", True, "developing", "high", 3, 2, 2, 1, 2, 2)], "cluster_id long, sport string, tier string, latest_hours double, event_hours double, event_type string, stakes boolean, urgency string, confidence string, domains int, variants int, known_domains int, last_15m int, last_hour int, providers int")
    row = row.withColumn("overrides", F.array(F.struct(F.lit("boost").alias("kind"), F.lit(500.0).alias("amount"))))
    r = ranking.score_parts(row).first()
    parts = {p.key: p.points for p in r.parts}
    assert parts["sport"] == 100 and parts["tier"] == 20 and parts["event"] == 45 and parts["stakes"] == 20 and parts["override.boost"] == 300
    assert abs(r.score - sum(parts.values())) < 0.011


def test_lag_and_streaks(spark):
    ts = lambda s: F.lit(s).cast("timestamp")
    lag = spark.range(1).select(health.file_lag(ts("2024-01-01 01:00"), ts("2024-01-01 00:45"), ts("2024-01-01 00:30")).alias("l")).first().l
    assert (lag.steps, lag.cause) == (2, "ingest-behind")
    rows = [("ok", "succeeded"), ("ok", "succeeded"), ("empty", "partial"), ("error", "failed"), ("throttled", "failed"), (None, "running"), ("throttled", "failed")]
    runs = spark.createDataFrame([(1, i, dt.datetime(2024, 1, 1, i), s, p) for i, (p, s) in enumerate(rows)], "provider long, run_id long, at timestamp, status string, provider_state string")
    r = health.leading_streaks(runs, "provider", "at").first()
    assert (r.failures, r.throttles, r.empties, r.runs, r.latest_status) == (3, 2, 0, 7, "failed")
    assert r.last_success_at == dt.datetime(2024, 1, 1, 2) and r.latest_error is None


def gkg_line(title, stamp="20240101001500", translated="", cells=27):
    row = [""] * cells
    row[1], row[3], row[4], row[25 if cells > 25 else 0], row[-1] = stamp, "espn.com", "https://www.espn.com/a?utm_source=x", translated, f"<PAGE_TITLE>{title}</PAGE_TITLE>"
    return "\t".join(row)


def test_gkg(spark, tmp_path):
    lines = [gkg_line("Lakers beat Celtics in NBA opener &#8211; caf&#xe9; | Site"), gkg_line("Other things happened today", translated="srclc:spa"), gkg_line("short row", cells=20), gkg_line("Lakers beat nobody in NBA", stamp="20240230000000")]
    parsed = gkg.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    rows = {r.title: r for r in parsed.collect()}
    assert "Lakers beat Celtics in NBA opener – café | Site" in rows and len(rows) == 3
    assert rows["Lakers beat nobody in NBA"].reported_at is None
    found = gkg.candidates(parsed, F.lit("2024-01-01").cast("timestamp")).collect()
    assert {r.sport for r in found} == {"basketball"} and {r.normalized_url for r in found} == {"https://www.espn.com/a"}
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.csv", "\n".join(lines))
    (tmp_path / "20240101001500.gkg.csv.zip").write_bytes(raw.getvalue())
    assert gkg.parse_lines(gkg.read_zipped(spark, str(tmp_path))).count() == 3


def test_wikitext(spark):
    page = "'''Politics'''\n* [https://x.com/p (Pol)]\n'''Sports'''\n*2024 season\n**The [[Cubs|Chicago Cubs]] beat the ''Reds''. [https://a.com/1 (AP)] [https://b.com/2 (BBC)]\n* Golf final [https://c.com/3 (CNN)]\n<!-- end -->\n* later [https://d.com/4 (X)]"
    rows = wikitext.parse_sports(spark.createDataFrame([("2024-01-01", page)], "day string, wikitext string")).orderBy("line", "url").collect()
    assert [(r.item, r.parent, r.url, r.publisher) for r in rows] == [
        ("The Chicago Cubs beat the Reds.", "2024 season", "https://a.com/1", "AP"),
        ("The Chicago Cubs beat the Reds.", "2024 season", "https://b.com/2", "BBC"),
        ("Golf final", None, "https://c.com/3", "CNN"),
    ]


def test_json_feeds(spark):
    body = '{"articles": [{"url": "https://a.com/1", "title": "T", "seendate": "20240101T001500Z", "language": "English"}]}'
    df = spark.createDataFrame([(body,), ("{}",)], "body string")
    rows = json_feeds.artlist(df, F.lit("2024-01-01").cast("timestamp"), F.lit("football")).collect()
    assert len(rows) == 1 and rows[0].published_at == dt.datetime(2024, 1, 1, 0, 15) and rows[0].query_sport == "football"
    news = spark.createDataFrame([('{"results": [{"article_id": "7", "title": "T", "link": "https://b.com", "pubDate": "2024-01-01 02:00:00", "category": ["sports"]}]}',)], "body string")
    assert json_feeds.newsdata(news, F.lit("2024-01-01").cast("timestamp"), F.lit(None).cast("string")).first().provider_item_id == "7"
    assert json_feeds.query_terms(["NFL", "college football"]) == 'NFL OR "college football"'


def test_streams(spark, tmp_path):
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    rows = [(i % 4, dt.datetime(2024, 1, 1, i % 24)) for i in range(48)]
    df = spark.createDataFrame(rows, "cluster long, at timestamp")
    df.write.parquet(src)
    for _ in range(2):  # nothing new the second time
        ingest.write_batches(ingest.dedupe(ingest.unit_stream(spark, src, df.schema), ["cluster"], "at"), out, cp).awaitTermination()
    assert spark.read.parquet(out).count() == 4
    q = ingest.cluster_activity(ingest.unit_stream(spark, src, df.schema), "cluster", "at").writeStream.format("memory").queryName("activity").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.cluster, r.members, r.status) for r in spark.table("activity").collect()} == {(k, 12, "open") for k in range(4)}


def test_ingest_unit_is_idempotent(spark):
    from tickerloom.operators import ingest_unit as unit

    columns = "candidate_id long, normalized_url string, provider long, provider_item_id string, normalized_headline string, headline_kind string, domain string, name string, quality string, fingerprint string"
    batch = spark.createDataFrame([(1, "u1", 1, None, "a", "t", "x.com", "X", "known", "f1"), (2, "u1", 1, None, "b", "t", "x.com", None, "known", "f1"), (3, "u3", 1, None, "a", "t", "off.com", None, "unknown", "f3"), (4, "u4", 1, "i", "a", "t", "y.com", None, "unknown", "f4")], columns)
    refused = spark.createDataFrame([(1, "f9", ["non-english"], "z.com", None, "unknown")], "provider long, fingerprint string, reasons array<string>, domain string, name string, quality string")
    stored = spark.createDataFrame([], columns + ", is_root boolean")
    sources = spark.createDataFrame([("off.com", None, "unknown", False)], "domain string, name string, quality string, enabled boolean")
    units = spark.createDataFrame([("k0",)], "unit_key string")
    r = unit.ingest_unit(batch, refused, stored, sources, units, "k1", "run")
    assert {(c.candidate_id, c.root_id) for c in r.candidates.collect()} == {(1, 1), (4, 1)}
    assert sorted(s.created_candidate for s in r.sightings.collect()) == [False, True, True]
    assert {x.domain for x in r.sources.collect()} == {"x.com", "y.com", "z.com"}
    n = r.counters.first()
    assert (n.returned, n.inserted, n.duplicates, n.rejected, n.unit_skipped) == (3, 2, 1, 2, False)
    again = unit.ingest_unit(batch, refused, stored, sources, units, "k0", "run").counters.first()
    assert (again.returned, again.rejected, again.unit_skipped) == (0, 0, True)


def test_quarter_hour_counts_whole_reads_every_event(spark, tmp_path):
    from tickerloom.plans import queries as plans

    at = dt.datetime(2024, 1, 1, 10)
    rows = [(1, 7, "click", at), (5000, 7, "click", at + dt.timedelta(minutes=20)), (5001, 8, "click", at + dt.timedelta(minutes=20)), (90000, 7, "click", at + dt.timedelta(hours=1))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(r.n for r in plans.queries()["quarter_hour_counts_whole"](spark, str(tmp_path)).collect())
    assert got == [1, 1, 1]
