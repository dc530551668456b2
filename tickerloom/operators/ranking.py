"""Explainable ranking: signals, eligibility, urgency, itemised score, sections, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions import classify, fixed, text, times


def lookup(table: dict, key: Column, default=None) -> Column:
    """A small dictionary as a map literal."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(default))


def domain_reports(members: DataFrame) -> DataFrame:
    """(cluster_id, domain, first_at, quality): each enabled publisher's earliest report."""
    enabled = members.filter(F.col("enabled") & (F.coalesce("domain", F.lit("")) != ""))
    return enabled.groupBy("cluster_id", "domain").agg(F.min("reported_at").alias("first_at"), F.min_by("quality", F.struct("reported_at", "quality")).alias("quality"))


def signals(members: DataFrame, now: Column) -> DataFrame:
    """A row a cluster: domains, known_domains, variants, sources in the last 15 and 60 minutes, and the headlines' language flags."""
    reports = domain_reports(members).withColumn("age", F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros("first_at")) / 6e7))
    by_domain = reports.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("domains"),
        F.count_if(F.col("quality") == "known").alias("known_domains"),
        F.count_if(F.col("age") <= 15).alias("last_15m"),
        F.count_if(F.col("age") <= 60).alias("last_hour"),
    )
    title = F.col("headline_kind") == "publisher-title"
    h = F.when(title, F.col("headline"))
    words = members.groupBy("cluster_id").agg(
        F.count_distinct(F.when(title & F.col("enabled"), text.normalize_variant(F.col("headline")))).alias("variants"),
        F.coalesce(F.bool_or(F.regexp_replace(h, fixed.RETROSPECTIVE, "").rlike(fixed.STAKES)), F.lit(False)).alias("stakes"),
        F.coalesce(F.bool_or(h.rlike(fixed.SPECULATIVE)), F.lit(False)).alias("speculative"),
        F.coalesce(F.bool_or(h.rlike(fixed.COLLEGE_WORDS)), F.lit(False)).alias("college_words"),
        F.count_if(h.rlike(fixed.BETTING_CLUSTER)).alias("betting"),
        F.count_if(title).alias("titles"),
        F.count(F.lit(1)).alias("members"),
        F.count_if(F.col("enabled")).alias("enabled_members"),
        F.count_if(F.col("enabled") & (F.col("quality") != "low-quality")).alias("better_members"),
    )
    filled = words.join(by_domain, "cluster_id", "left")
    return filled.fillna(0, ["domains", "known_domains", "last_15m", "last_hour"])


def infer_tier(league: Column, sport: Column, entities: Column, college_words: Column) -> Column:
    """Competition tier: the league's, else college leagues, words or teams, else professional ones, else by sport."""
    of = lambda kind: F.transform(F.filter(entities, lambda e: e.startswith(kind)), lambda e: F.substr(e, F.lit(len(kind) + 1)))
    within = lambda found, names: F.arrays_overlap(found, F.array(*[F.lit(n) for n in names]))
    teams, leagues = of("team:"), of("league:")
    return (
        F.when(lookup(fixed.LEAGUE_TIER, F.lower(league)).isNotNull(), lookup(fixed.LEAGUE_TIER, F.lower(league)))
        .when(within(leagues, fixed.COLLEGE_LEAGUES) | college_words, "college")
        .when(within(teams, classify.college_teams()) & ~within(teams, classify.pro_teams()), "college")
        .when(within(leagues, fixed.PRO_LEAGUES) | within(teams, classify.pro_teams()), "professional")
        .when(sport == "olympics", "international")
        .when(sport.isin("basketball", "football", "baseball"), "unspecified-major")
        .otherwise("professional")
    )


def importance(event_type: Column) -> Column:
    return lookup(fixed.EVENT_IMPORTANCE, F.coalesce(event_type, F.lit("unknown")), fixed.EVENT_IMPORTANCE["unknown"])


def corroborated(points: Column, domains: Column) -> Column:
    """Positive importance counts half for one publisher and four fifths for two."""
    return F.when(points <= 0, points.cast("double")).otherwise(points * F.when(domains >= 3, 1.0).when(domains == 2, 0.8).otherwise(0.5))


def breadth(domains: Column, variants: Column, known: Column, providers: Column, event_type: Column) -> Column:
    """Points by (domains, variants, confirmation, providers): logarithmic, less for results and previews."""
    factor = F.when(event_type == "game-result", 0.55).when(event_type == "preview", 0.4).otherwise(1.0)
    return F.struct(
        (34 * times.log_saturation(domains, 20) * factor).alias("domains"),
        (8 * times.log_saturation(variants, 6) * factor).alias("variants"),
        F.when(known >= 3, 6.0).when(known == 2, 3.0).otherwise(0.0).alias("known"),
        F.least(F.lit(2.0), F.greatest(F.lit(0.0), (providers - 1).cast("double"))).alias("providers"),
    )


def velocity(domains: Column, last_15m: Column, last_hour: Column, event_type: Column) -> Column:
    """New publishers: 5 points each in 15 minutes (four at most), 2 each in the rest of the hour (five at most); from two domains on."""
    factor = F.when(event_type == "game-result", 0.4).when(event_type == "preview", 0.3).otherwise(1.0)
    points = (F.least(F.lit(4), last_15m) * 5 + F.least(F.lit(5), last_hour - last_15m) * 2) * factor
    return F.when((domains < 2) | (last_hour == 0), 0.0).otherwise(points)


def urgency(event_type: Column, latest_hours: Column, domains: Column, last_hour: Column, confidence: Column, speculative: Column) -> Column:
    """normal, developing or breaking-candidate; a lone source, unclear events and speculation are always normal."""
    plain = speculative | event_type.isNull() | ~event_type.isin(fixed.NEWSY) | (domains < 2) | (confidence == "low")
    breaking = event_type.isin(fixed.BREAKING) & (confidence == "high") & (latest_hours <= 2) & (last_hour >= 2)
    return F.when(plain, "normal").when(breaking, "breaking-candidate").when(latest_hours <= 6, "developing").otherwise("normal")


def desk(sport: Column) -> Column:
    return lookup(fixed.DESKS, sport, fixed.OTHER_DESK)


def priority(score: Column) -> Column:
    return F.when(score >= 210, 1).when(score >= 170, 2).when(score >= 130, 3).otherwise(4)


def eligibility(c: DataFrame, now: Column) -> DataFrame:
    """Adds reasons (code, severity) and state: ineligible, review or eligible.

    Needs the signal columns and status, confidence, headline_ok (a publishable representative), newest_at, risky_near_misses, item_status.
    """
    age = times.hours_between(now, F.col("newest_at"))
    rules = [
        ("closed-cluster", "ineligible", F.col("status") == "closed"),
        ("needs-review-state", "ineligible", F.col("status") == "needs_review"),
        ("discovery-text-only", "ineligible", (F.col("members") > 0) & (F.col("titles") == 0)),
        ("no-publisher-headline", "ineligible", ~((F.col("members") > 0) & (F.col("titles") == 0)) & ~F.col("headline_ok")),
        ("betting-or-fantasy", "ineligible", (F.col("titles") > 0) & (F.col("betting") * 2 >= F.col("titles"))),
        ("low-confidence", "ineligible", F.col("confidence") == "low"),
        ("medium-confidence", "review", F.col("confidence") == "medium"),
        ("all-sources-disabled", "ineligible", (F.col("members") > 0) & (F.col("enabled_members") == 0)),
        ("all-sources-low-quality", "ineligible", (F.col("enabled_members") > 0) & (F.col("better_members") == 0)),
        ("too-old", "ineligible", age > 48),
        ("unresolved-near-miss", "review", F.col("risky_near_misses") > 0),
        ("editor-rejected", "ineligible", F.col("item_status") == "rejected"),
        ("editor-held", "ineligible", F.col("item_status") == "held"),
    ]
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))) for code, sev, test in rules]))
    state = F.when(F.exists("reasons", lambda r: r["severity"] == "ineligible"), "ineligible").when(F.exists("reasons", lambda r: r["severity"] == "review"), "review").otherwise("eligible")
    return c.withColumn("reasons", reasons).withColumn("state", state)


def sections(c: DataFrame) -> DataFrame:
    """Adds lead_ok, wire_ok, now_ok, desk_ok. Needs state, headline_ok, confidence, event_type, urgency, domains, last_hour, latest_hours,
    stakes, speculative, better_members, members."""
    usable = (F.col("state") != "ineligible") & F.col("headline_ok")
    kind = F.coalesce("event_type", F.lit("unknown"))
    preview, newsy, strong = kind == "preview", kind.isin(fixed.NEWSY), kind.isin(fixed.STRONG_NEWS)
    supported = (F.col("domains") >= 3) | ((F.col("domains") >= 2) & (importance(F.col("event_type")) >= 40))
    routine = (kind == "game-result") & ~F.col("stakes") & (F.col("domains") < 12)
    low = (F.col("members") > 0) & (F.col("better_members") == 0)
    lead = usable & (F.col("state") == "eligible") & (F.col("confidence") == "high") & (F.col("latest_hours") <= 12) & ~preview & ~low & supported & ~routine
    fast = (F.col("domains") >= 4) & (F.col("last_hour") >= 2) & (newsy | F.col("stakes"))
    wire = usable & ~preview & ~F.col("speculative") & (F.col("domains") >= 2) & (F.col("latest_hours") <= 6) & ((F.col("urgency") != "normal") | fast)
    on_desk = usable & ~preview & ((F.col("domains") >= 2) | (strong & ~F.col("speculative")))
    return c.withColumns({"lead_ok": lead, "wire_ok": wire, "now_ok": on_desk & (F.col("latest_hours") <= 12), "desk_ok": on_desk})


def score_parts(c: DataFrame) -> DataFrame:
    """Adds parts (key, points; those of no points but the basic ones left out) and score, their sum to two digits.

    Needs sport, tier, latest_hours, event_hours, event_type, stakes, urgency, confidence and the signal columns with providers; overrides as
    an array of (kind, amount, text).
    """
    b = breadth(F.col("domains"), F.col("variants"), F.col("known_domains"), F.col("providers"), F.col("event_type"))
    base = importance(F.col("event_type"))
    cents = lambda x: F.round(x.cast("decimal(20,8)"), 2).cast("double")
    part = lambda key, points, always=False: F.when(F.lit(always) | (points != 0), F.struct(F.lit(key).alias("key"), points.cast("double").alias("points")))
    stakes = F.when(F.col("stakes") & ~F.coalesce(F.col("event_type") == "preview", F.lit(False)), 20.0).otherwise(0.0)
    basic = F.array_compact(
        F.array(
            part("sport", lookup(fixed.SPORT_WEIGHT, F.col("sport"), 45), True),
            part("tier", lookup(fixed.TIER_POINTS, F.col("tier"), 0), True),
            part("recency", cents(times.recency_points(F.col("latest_hours"), F.col("event_hours"))), True),
            part("event", cents(corroborated(base, F.col("domains"))), True),
            part("stakes", stakes),
            part("breadth.sources", cents(b["domains"]), True),
            part("breadth.independence", cents(b["variants"])),
            part("breadth.confirmation", b["known"]),
            part("breadth.providers", b["providers"]),
            part("velocity", cents(velocity(F.col("domains"), F.col("last_15m"), F.col("last_hour"), F.col("event_type")))),
            part("urgency", lookup({"developing": 12, "breaking-candidate": 30, "normal": 0}, F.col("urgency"), 0)),
            part("corroboration", F.when(F.col("domains") <= 1, -15.0).otherwise(0.0)),
            part("confidence", lookup({"high": 5, "medium": -25, "low": 0}, F.col("confidence"), 0)),
        )
    )
    return apply_overrides(c.withColumn("parts", basic))


def total(parts: Column) -> Column:
    return F.round(F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["points"]).cast("decimal(20,8)"), 2).cast("double")


def apply_overrides(c: DataFrame) -> DataFrame:
    """Editors' pins (+1000), boosts (300 at most), suppressions (80 unless given) and forced priorities as further parts; adds score."""
    points = lambda o: F.when(o["kind"] == "pin", 1000.0).when(o["kind"] == "boost", F.least(F.lit(300.0), F.coalesce(o["amount"], F.lit(0.0)))).when(o["kind"] == "suppress", -F.coalesce(o["amount"], F.lit(80.0)))
    simple = F.transform(F.filter("overrides", lambda o: o["kind"].isin("pin", "boost", "suppress")), lambda o: F.struct(F.concat(F.lit("override."), o["kind"]).alias("key"), points(o).alias("points")))
    with_simple = c.withColumn("parts", F.concat("parts", simple))
    forced = F.filter("overrides", lambda o: o["kind"] == "force_priority")
    extra = F.transform(forced, lambda o: F.struct(F.lit("override.force_priority").alias("key"), (F.coalesce(o["amount"], F.lit(0.0)) - total(F.col("parts"))).alias("points")))
    return with_simple.withColumn("parts", F.concat("parts", F.slice(extra, 1, 1))).withColumn("score", total(F.col("parts")))


def rank(scored: DataFrame) -> DataFrame:
    """Adds position, for all but ineligible rows: score, sport weight, newest, id.

    Positions are a global order; rows are range-partitioned and sorted, and a partition's first position is the count before it.
    The partitioning is checkpointed, as both readers must see the same one: the session needs a checkpoint folder.
    """
    weight = lookup(fixed.SPORT_WEIGHT, F.col("sport"), 0)
    order = [F.col("score").desc(), weight.desc(), F.col("newest_at").desc(), F.col("cluster_id").asc()]
    ranged = scored.filter("state <> 'ineligible'").repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).checkpoint()
    before = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).withColumn("__before", F.sum("n").over(Window.orderBy("__part")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    placed = ranged.withColumn("__within", within).join(before, "__part").withColumn("position", F.col("__before") + F.col("__within")).drop("__part", "__before", "__within")
    return placed.unionByName(scored.filter("state = 'ineligible'").withColumn("position", F.lit(None).cast("long")))


def supporting_sources(members: DataFrame) -> DataFrame:
    """One row an enabled domain of each cluster: its representative member, else its earliest; in reading order by ``nth``."""
    enabled = members.filter("enabled")
    pick = Window.partitionBy("cluster_id", "domain").orderBy(F.col("is_representative").desc(), F.col("reported_at"), F.col("candidate_id"))
    one = enabled.withColumn("__n", F.row_number().over(pick)).filter("__n = 1").drop("__n")
    rank_of = lookup({"known": 0, "unknown": 1, "low-quality": 2}, F.col("quality"), 3)
    order = Window.partitionBy("cluster_id").orderBy(F.col("is_representative").desc(), rank_of, F.col("reported_at"), F.col("domain"))
    return one.withColumn("nth", F.row_number().over(order))


def active_overrides(log: DataFrame) -> DataFrame:
    """The standing override of each (item, kind): the latest that is not removed; earlier ones are superseded."""
    latest = Window.partitionBy("item_id", "kind").orderBy(F.col("created_at").desc(), F.col("override_id").desc())
    return log.withColumn("__n", F.row_number().over(latest)).filter("__n = 1 and removed_at is null").drop("__n")


def upsert_items(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored items (cluster_id, headline, score, status) after a run: new ones are candidates or, if their eligibility is in review, in review; known ones keep their status, but an
    approved item whose headline changed goes back to review."""
    new = fresh.select("cluster_id", F.col("headline").alias("__h"), F.col("score").alias("__s"), "eligibility")
    both = stored.withColumn("__stored", F.lit(True)).join(new.withColumn("__fresh", F.lit(True)), "cluster_id", "full")
    first = F.when(F.col("eligibility") == "review", "review").otherwise("candidate")
    changed = (F.col("status") == "approved") & F.col("__fresh") & ~F.col("headline").eqNullSafe(F.col("__h"))
    status = F.when(F.col("__stored").isNull(), first).when(F.coalesce(changed, F.lit(False)), "review").otherwise(F.col("status"))
    use = lambda old, fresh_col: F.when(F.col("__fresh"), F.col(fresh_col)).otherwise(F.col(old))
    return both.select("cluster_id", use("headline", "__h").alias("headline"), use("score", "__s").alias("score"), status.alias("status"))


def may_approve(headline: Column, state: Column, status: Column) -> Column:
    """Whether an editor may approve: a headline, not ineligible, neither held nor rejected."""
    return (F.trim(F.coalesce(headline, F.lit(""))) != "") & (F.coalesce(state, F.lit("")) != "ineligible") & ~status.isin("held", "rejected")
