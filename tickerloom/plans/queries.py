"""Registered queries over the driver's tables, each with equivalent DuckDB SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom import storage
from tickerloom.functions import classify, fixed, text, times, urls
from tickerloom.operators import assignment, clustering, editorial, health, ingest_unit, intake, joins, nearby, ranking, slate, terms, warehouse

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
NOW = "2024-01-31 00:00:00"


def query(sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            if spark.sparkContext.getCheckpointDir() is None:
                spark.sparkContext.setCheckpointDir(storage.shared_dir(spark))
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return run

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _now():
    return F.lit(NOW).cast("timestamp")


def _micros(name: str):
    return F.unix_micros(F.col(name)).alias(name)


_LIST = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"

# --- pages ---------------------------------------------------------------------------------------------------------------

_PAGES = f"""
WITH p0 AS (SELECT page_id, html, trim(url) AS u FROM pages),
p1 AS (SELECT page_id, html, u, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) AS scheme,
  lower(regexp_extract(u, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#]+)', 1)) AS host0,
  regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path0, regexp_extract(u, '^[^?#]*\\?([^#]*)', 1) AS q FROM p0),
p2 AS (SELECT *, CASE WHEN scheme = 'http' THEN regexp_replace(host0, ':80$', '') ELSE regexp_replace(host0, ':443$', '') END AS host,
  list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT list_contains({_LIST(fixed.TRACKING_PARAMS)}, lower(string_split(x, '=')[1]))) AS kept FROM p1),
p3 AS (SELECT page_id, html, u, CASE WHEN scheme IN ('http', 'https') AND host <> '' THEN
  scheme || '://' || host || CASE WHEN path0 = '' THEN '/' ELSE path0 END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS normalized FROM p2),
norm AS (SELECT page_id, html, normalized, regexp_replace(regexp_extract(normalized, '^[a-z]+://([^/?#:]+)', 1), '^www\\.', '') AS domain,
  substr(sha1(coalesce(normalized, lower(u))), 1, 16) AS fingerprint FROM p3)
"""


def _normalized_pages(t) -> DataFrame:
    u = F.col("url")
    return t("pages").select("page_id", "html", u.alias("url"), urls.normalize_url(u).alias("normalized"), urls.domain(u).alias("domain"), urls.fingerprint(u).alias("fingerprint"))


@query(_PAGES + "SELECT page_id, normalized, domain, fingerprint FROM norm")
def url_normalize_fingerprint(t):
    return _normalized_pages(t).select("page_id", "normalized", "domain", "fingerprint")


@query(_PAGES + ", f AS (SELECT normalized, min(page_id) AS page_id, count(*) AS copies FROM norm WHERE normalized IS NOT NULL GROUP BY normalized) SELECT page_id, normalized, copies FROM f")
def url_dedupe_first_wins(t):
    pages = _normalized_pages(t).select("page_id", "normalized").filter("normalized is not null")
    return warehouse.first_wins(pages, "normalized", F.col("page_id")).select("page_id", "normalized", "copies")


@query(_PAGES + ", f AS (SELECT DISTINCT ON (normalized) * FROM norm WHERE normalized IS NOT NULL ORDER BY normalized, page_id) SELECT domain, count(*) AS pages, min(page_id) AS first_page FROM f GROUP BY domain")
def host_counts(t):
    pages = _normalized_pages(t).select("page_id", "domain", "normalized").filter("normalized is not null")
    return warehouse.first_wins(pages, "normalized", F.col("page_id")).groupBy("domain").agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"))


_within = lambda names: " OR ".join(f"domain = '{n}' OR domain LIKE '%.{n}'" for n in names)


@query(_PAGES + f"SELECT page_id, CASE WHEN {_within(fixed.LOW_QUALITY_DOMAINS)} THEN 'low-quality' WHEN {_within(fixed.KNOWN_DOMAINS)} THEN 'known' ELSE 'unknown' END AS quality FROM norm")
def source_quality_bucket(t):
    return _normalized_pages(t).select("page_id", urls.source_quality(F.col("domain")).alias("quality"))


_TITLE = r"""
WITH t0 AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS raw FROM pages),
t1 AS (SELECT page_id, replace(replace(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&') AS title FROM t0),
t2 AS (SELECT page_id, title, trim(regexp_extract(title, '(?s)^(.+) \| ', 1)) AS pipe, trim(regexp_extract(title, '(?s)^(.+) [–—-] ', 1)) AS head,
  trim(regexp_extract(title, '(?s)^.+ [–—-] (.*)$', 1)) AS tail FROM t1),
w AS (SELECT *, len(list_filter(regexp_split_to_array(pipe, '\s+'), lambda x: x <> '')) AS pw, len(list_filter(regexp_split_to_array(head, '\s+'), lambda x: x <> '')) AS hw,
  len(list_filter(regexp_split_to_array(tail, '\s+'), lambda x: x <> '')) AS tw FROM t2)
SELECT page_id, title, CASE WHEN pipe <> '' AND pw >= 3 THEN pipe WHEN head <> '' AND hw >= 3 AND tw <= 6 AND regexp_matches(tail, '%s') THEN head ELSE title END AS headline FROM w
""" % fixed.PUBLISHER_WORDS  # noqa: UP031


@query(_TITLE)
def page_title_extract(t):
    raw = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return t("pages").select("page_id", text.decode_entities(raw).alias("title")).withColumn("headline", text.strip_site_suffix(F.col("title")))


# --- candidates ----------------------------------------------------------------------------------------------------------

_CAND = rf"""
WITH c0 AS (
  SELECT d.doc_id AS candidate_id, string_split(d.text, chr(10))[1] AS headline, d.source, d.lang, e.event_type AS sport, e.ts AS discovered_at, e.ts AS created_at,
    CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE e.ts - to_minutes(d.doc_id % 180) END AS published_at, d.doc_id % 4 AS provider,
    CASE WHEN d.doc_id % 9 = 0 THEN 'discovery-text' ELSE 'publisher-title' END AS headline_kind,
    ['low', 'medium', 'high'][(d.doc_id % 3 + 1)::INT] AS confidence, ['new', 'accepted', 'rejected'][(d.doc_id % 5 // 2 + 1)::INT] AS status, d.doc_id % 11 <> 0 AS enabled
  FROM documents d JOIN events e ON e.event_id = d.doc_id),
cand AS (SELECT *, trim(regexp_replace(lower(replace(regexp_replace(headline, '[‐-―−]', '-', 'g'), '…', '...')), '\s+', ' ', 'g')) AS normalized_headline,
  coalesce(published_at, discovered_at) AS fresh_at FROM c0)
"""


def _cand(t) -> DataFrame:
    d, e = t("documents"), t("events").select("event_id", F.col("event_type").alias("sport"), F.col("ts").cast("timestamp").alias("discovered_at"))
    i = F.col("doc_id")
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (n + 1).cast("int"))
    rows = d.join(e, d["doc_id"] == e["event_id"]).select(
        i.alias("candidate_id"),
        F.split("text", "\n")[0].alias("headline"),
        "source",
        "lang",
        "sport",
        "discovered_at",
        F.col("discovered_at").alias("created_at"),
        F.when(i % 7 != 0, F.timestamp_micros((F.unix_micros("discovered_at") - (i % 180) * 60_000_000).cast("long"))).alias("published_at"),
        (i % 4).alias("provider"),
        F.when(i % 9 == 0, "discovery-text").otherwise("publisher-title").alias("headline_kind"),
        pick(["low", "medium", "high"], i % 3).alias("confidence"),
        pick(["new", "accepted", "rejected"], F.floor((i % 5) / 2)).alias("status"),
        (i % 11 != 0).alias("enabled"),
    )
    return rows.withColumns({"normalized_headline": text.normalize_headline(F.col("headline"), unicode_form=False), "fresh_at": F.coalesce("published_at", "discovered_at")})


@query(
    _CAND
    + """, n AS (SELECT headline_kind, normalized_headline, sport, count(*) AS n FROM cand GROUP BY ALL),
m AS (SELECT headline_kind, normalized_headline, sport FROM (SELECT *, row_number() OVER (PARTITION BY headline_kind, normalized_headline ORDER BY n DESC, sport) AS r FROM n) WHERE r = 1)
SELECT c.headline_kind, c.normalized_headline, arg_min(headline, (created_at, candidate_id)) AS sample_headline, count(*) AS candidate_count, count(DISTINCT source) AS source_count,
  count(DISTINCT provider) AS provider_count, epoch_us(min(discovered_at)) AS first_seen_at, epoch_us(max(discovered_at)) AS last_seen_at, epoch_us(min(published_at)) AS first_published_at,
  arg_min(candidate_id, (created_at, candidate_id)) AS root_id, any_value(m.sport) AS sport
FROM cand c JOIN m ON m.headline_kind = c.headline_kind AND m.normalized_headline = c.normalized_headline GROUP BY c.headline_kind, c.normalized_headline"""
)
def headline_groups(t):
    g = warehouse.headline_groups(_cand(t))
    return g.withColumns({c: F.unix_micros(c) for c in ("first_seen_at", "last_seen_at", "first_published_at")})


_q = lambda s: s.replace("'", "''")
_any_of = lambda col, patterns: "(" + " OR ".join(f"regexp_matches({col}, '{_q(p)}')" for p in patterns) + ")"
_REASONS = (
    _CAND
    + rf""", r AS (SELECT candidate_id, list_filter([
  CASE WHEN len(list_filter(regexp_split_to_array(headline, '\s+'), lambda x: x <> '')) < 3 OR length(regexp_replace(headline, '[^\p{{L}}]', '', 'g')) < 12 OR regexp_matches(headline, '(?i)^https?://') THEN 'malformed-headline' END,
  CASE WHEN NOT regexp_matches(lang, '(?i)^(en|eng|english)\b') OR regexp_matches(headline, '{fixed.SPANISH_CLIP}') THEN 'non-english' END,
  CASE WHEN {_any_of("headline", fixed.BETTING)} OR (regexp_matches(headline, '{fixed.BARE_ODDS}') AND NOT regexp_matches(headline, '{fixed.ODDS_IDIOM}')) THEN 'betting-or-fantasy' END,
  CASE WHEN {_any_of("headline", fixed.TEMPLATE_PAGES)} THEN 'template-page' END,
  CASE WHEN {_any_of("headline", fixed.VIDEO_TITLES)} THEN 'video-page' END,
  CASE WHEN candidate_id % 13 = 0 THEN 'generic-page' END,
  CASE WHEN regexp_matches(headline, '{fixed.HISTORICAL_STATS}') THEN 'historical-stats-page' END,
  CASE WHEN candidate_id % 10 = 0 AND confidence = 'low' THEN 'not-sports' END,
  CASE WHEN candidate_id % 17 = 0 THEN 'low-quality-source' END], lambda x: x IS NOT NULL) AS reasons FROM cand)
"""
)


def _judged(t) -> DataFrame:
    i = F.col("candidate_id")
    url = F.when(i % 13 == 0, "https://a.example/").otherwise(F.concat(F.lit("https://a.example/news/"), i.cast("string")))
    categories = F.when(i % 10 == 0, F.array(F.lit("politics")))
    quality = F.when(i % 17 == 0, "low-quality").otherwise("unknown")
    return _cand(t).select("candidate_id", "sport", intake.reject_reasons(F.col("headline"), url, F.col("lang"), categories, F.col("confidence"), quality).alias("reasons"))


@query(_REASONS + "SELECT candidate_id, array_to_string(reasons, ',') AS reasons FROM r")
def intake_reasons(t):
    return _judged(t).select("candidate_id", F.array_join("reasons", ",").alias("reasons"))


@query(_REASONS + "SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY reason")
def reject_reason_counts(t):
    return _judged(t).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(_REASONS + "SELECT c.sport, count(*) FILTER (WHERE len(reasons) = 0) AS accepted, count(*) FILTER (WHERE len(reasons) > 0) AS rejected FROM r JOIN cand c USING (candidate_id) GROUP BY c.sport")
def intake_summary(t):
    return _judged(t).groupBy("sport").agg(F.count_if(F.size("reasons") == 0).alias("accepted"), F.count_if(F.size("reasons") > 0).alias("rejected"))


@query(
    _CAND
    + """SELECT candidate_id, source, CASE WHEN headline_kind = 'publisher-title' THEN headline END AS publisher_headline, epoch_us(fresh_at) AS fresh_at FROM cand
WHERE status IN ('new', 'accepted') AND confidence IN ('medium', 'high') AND headline_kind = 'publisher-title' AND fresh_at >= TIMESTAMP '2024-01-02'
  AND source NOT IN ('src3', 'src7') ORDER BY cand.fresh_at DESC, candidate_id DESC LIMIT 200"""
)
def candidate_feed(t):
    sources = t("documents").select("source").distinct().select("source", F.col("source").alias("source_name"), (~F.col("source").isin("src3", "src7")).alias("enabled"))
    feed = warehouse.candidate_feed(_cand(t).drop("fresh_at", "enabled"), sources, F.lit("2024-01-02").cast("timestamp"), min_confidence="medium", limit=200)
    return feed.select("candidate_id", "source", "publisher_headline", _micros("fresh_at"))


@query(
    _CAND
    + """SELECT candidate_id, source, headline AS shown, epoch_us(fresh_at) AS fresh_at FROM cand WHERE status IN ('new', 'rejected') AND sport IN ('click', 'view') AND provider IN (1, 2) AND ['known', 'unknown', 'low-quality'][(ascii(right(source, 1)) % 3 + 1)::INT] IN ('known', 'unknown')
  AND published_at >= TIMESTAMP '2024-01-01 03:00:00' AND published_at <= TIMESTAMP '2024-01-28' AND discovered_at >= TIMESTAMP '2024-01-01 04:00:00' AND discovered_at <= TIMESTAMP '2024-01-27' ORDER BY cand.fresh_at DESC, candidate_id DESC LIMIT 500"""
)
def candidate_feed_knobs(t):
    """The feed with every knob turned: discovery text and disabled sources too, providers, qualities and both ranges."""
    quality = F.element_at(F.array(F.lit("known"), F.lit("unknown"), F.lit("low-quality")), (F.ascii(F.right("source", F.lit(1))) % 3 + 1).cast("int"))
    sources = t("documents").select("source").distinct().select("source", F.col("source").alias("source_name"), (~F.col("source").isin("src3", "src7")).alias("enabled"), quality.alias("quality"))
    at = lambda s: F.lit(s).cast("timestamp")
    feed = warehouse.candidate_feed(
        _cand(t).drop("fresh_at", "enabled"), sources, sports=["click", "view"], statuses=("new", "rejected"), publisher_only=False, limit=9000, providers=[1, 2], qualities=["known", "unknown"],
        published=(at("2024-01-01 03:00:00"), at("2024-01-28")), discovered=(at("2024-01-01 04:00:00"), at("2024-01-27")), disabled_sources=True,
    )
    return feed.select("candidate_id", "source", F.coalesce("publisher_headline", "discovery_text").alias("shown"), _micros("fresh_at"))



@query(
    _CAND
    + """SELECT 'candidates' AS metric, NULL AS key, count(*)::DOUBLE AS value FROM cand
UNION ALL SELECT 'headlines', NULL, count(DISTINCT (headline_kind, normalized_headline))::DOUBLE FROM cand
UNION ALL SELECT 'published', NULL, count(published_at)::DOUBLE FROM cand
UNION ALL SELECT 'duplicate_rate', NULL, round((1 - count(DISTINCT (headline_kind, normalized_headline))::DOUBLE / count(*))::DECIMAL(20,10), 4)::DOUBLE FROM cand
UNION ALL SELECT 'by_sport', sport, count(*)::DOUBLE FROM cand GROUP BY sport UNION ALL SELECT 'by_confidence', confidence, count(*)::DOUBLE FROM cand GROUP BY confidence
UNION ALL SELECT 'by_provider', provider::VARCHAR, count(*)::DOUBLE FROM cand GROUP BY provider UNION ALL SELECT 'by_status', status, count(*)::DOUBLE FROM cand GROUP BY status"""
)
def warehouse_stats(t):
    return warehouse.warehouse_stats(_cand(t))


@query(
    _CAND
    + """, s AS (SELECT source AS domain, CASE WHEN candidate_id % 3 = 0 THEN NULL ELSE lang END AS name, ['known', 'low-quality', 'unknown'][(candidate_id % 3 + 1)::INT] AS quality FROM cand)
SELECT domain, name, quality FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY name IS NULL, quality, name) AS n FROM s) WHERE n = 1"""
)
def source_upsert(t):
    i = F.col("candidate_id")
    seen = _cand(t).select(F.col("source").alias("domain"), F.when(i % 3 != 0, F.col("lang")).alias("name"), F.element_at(F.array(F.lit("known"), F.lit("low-quality"), F.lit("unknown")), (i % 3 + 1).cast("int")).alias("quality"))
    return warehouse.upsert_sources(seen)


@query(
    _CAND
    + """, r AS (SELECT provider, source || ':' || lang AS fingerprint, candidate_id % 6 AS batch, headline AS source_url, sport AS reasons, candidate_id FROM cand),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY provider, fingerprint, batch ORDER BY source_url, candidate_id) AS n FROM r) WHERE n = 1)
SELECT provider, fingerprint, count(*) AS times_seen, min(batch) AS first_batch, max(batch) AS last_batch FROM o GROUP BY provider, fingerprint"""
)
def rejection_times_seen(t):
    r = _cand(t).select("provider", F.concat_ws(":", "source", "lang").alias("fingerprint"), (F.col("candidate_id") % 6).alias("batch"), F.col("headline").alias("source_url"), F.col("sport").alias("reasons"))
    return warehouse.rejection_log(r).drop("reasons")


@query(_CAND + "SELECT candidate_id, epoch_us(fresh_at) AS fresh_at FROM cand WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = candidate_id)")
def unclustered_queue(t):
    return warehouse.unclustered(_cand(t), t("labels").select(F.col("doc_id").alias("candidate_id"))).select("candidate_id", _micros("fresh_at"))


@query(_CAND + "SELECT candidate_id, source FROM cand WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = candidate_id AND l.quality = 1)")
def resolved_candidates(t):
    return _cand(t).join(t("labels").filter("quality = 1").select(F.col("doc_id").alias("candidate_id")), "candidate_id", "left_semi").select("candidate_id", "source")


@query("SELECT o_orderpriority, o_orderkey, o_totalprice, nth FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders) WHERE nth <= 25")
def per_key_first_n(t):
    top = warehouse.first_n(t("orders"), "o_orderpriority", 25, F.col("o_totalprice").desc(), F.col("o_orderkey"))
    return top.select("o_orderpriority", "o_orderkey", "o_totalprice", F.col("nth").cast("long").alias("nth"))


@query("SELECT page_id, row_number() OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/]+)', 1) ORDER BY page_id) > 1 AS duplicate FROM pages")
def duplicate_flags(t):
    pages = t("pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"))
    return warehouse.flag_copies(pages, "host", F.col("page_id")).select("page_id", "duplicate")


# --- joins ---------------------------------------------------------------------------------------------------------------


@query(
    """SELECT a.event_id AS id_a, b.event_id AS id_b, epoch_us(b.ts) - epoch_us(a.ts) AS apart FROM events a JOIN events b
ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 7200::BIGINT * 1000000"""
)
def interval_join(t):
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    a = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("id_a"), F.col("ts").alias("at_a"))
    b = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("id_b"), F.col("ts").alias("at_b"))
    near = joins.interval_pairs(a, b, "user_id", "at_a", "at_b", 7200)
    return near.select("id_a", "id_b", (F.unix_micros("at_b") - F.unix_micros("at_a")).alias("apart"))


_GRAMS = r"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(
    f"""WITH p AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY p_name), g AS (SELECT id, {_GRAMS.format("name")} AS grams FROM p),
x AS (SELECT a.id AS id_a, b.id AS id_b, len(list_intersect(a.grams, b.grams)) AS s, len(a.grams) AS na, len(b.grams) AS nb FROM g a JOIN g b ON a.id < b.id)
SELECT id_a, id_b, round(s::DOUBLE / (na + nb - s), 6) AS similarity FROM x WHERE s::DOUBLE / (na + nb - s) >= 0.3"""
)
def trigram_similarity_join(t):
    names = t("part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    return joins.trigram_pairs(names, "id", "p_name", 0.3).select("id_a", "id_b", F.round("similarity", 6).alias("similarity"))


@query(_CAND + "SELECT r.root, c.candidate_id AS id FROM cand c JOIN (SELECT headline_kind, normalized_headline, min(candidate_id) AS root FROM cand GROUP BY ALL) r USING (headline_kind, normalized_headline) WHERE c.candidate_id <> r.root")
def exact_headline_pairs(t):
    return joins.exact_pairs(_cand(t), "candidate_id", "headline_kind", "normalized_headline")


@query(
    r"""WITH a AS (SELECT item_id AS id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 3)) AS ws FROM benchmark),
b AS (SELECT doc_id AS id, list_distinct(list_filter(regexp_split_to_array(lower(string_split(text, chr(10))[1]), '[^a-z0-9]+'), lambda w: length(w) > 3)) AS ws FROM documents),
x AS (SELECT a.id AS id_a, b.id AS id_b, len(list_intersect(a.ws, b.ws)) AS s, len(a.ws) + len(b.ws) AS n FROM a JOIN b ON list_has_any(a.ws, b.ws))
SELECT id_a, id_b, round(s::DOUBLE / (n - s), 6) AS jaccard FROM x WHERE s::DOUBLE / (n - s) >= 0.1"""
)
def token_jaccard_pairs(t):
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) > 3)
    a = t("benchmark").select(F.col("item_id").alias("id"), words(F.col("text")).alias("tokens"))
    b = t("documents").select(F.col("doc_id").alias("id"), words(F.split("text", "\n")[0]).alias("tokens"))
    return joins.token_jaccard_pairs(a, b, 0.1).select("id_a", "id_b", F.round("jaccard", 6).alias("jaccard"))


# --- classification ------------------------------------------------------------------------------------------------------

_SMALL = {"strong": ["the", "von", "que"], "team": ["with", "nicht", "para"], "weak": ["that", "ein", "los"]}
_hit = lambda w: f"regexp_matches(h, '(^|[^\\p{{L}}\\p{{N}}]){w}($|[^\\p{{L}}\\p{{N}}])')"
_count = lambda ws: " + ".join(f"{_hit(w)}::INT" for w in ws)


@query(_CAND + f"SELECT candidate_id, (3 * ({_count(_SMALL['strong'])}) + 2 * ({_count(_SMALL['team'])}) + {_count(_SMALL['weak'])})::BIGINT AS score FROM (SELECT candidate_id, lower(headline) AS h FROM cand)")
def lexicon_evidence(t):
    c = _cand(t).select("candidate_id", F.lower("headline").alias("h"))
    c = c.withColumn("runs", text.phrases(F.col("h"), 1))
    n = lambda tier: F.size(classify.match_terms(F.col("h"), F.col("runs"), _SMALL[tier], False))
    return c.select("candidate_id", (3 * n("strong") + 2 * n("team") + n("weak")).cast("long").alias("score"))


_STEMS = {"trade": "the", "injury": "on", "record": "er", "death": "an", "signing": "in"}


def _synthetic_headline(col):
    """A headline in the lexicon's vocabulary from a row's number, so that the rules have something to match."""
    who = F.element_at(F.array(*[F.lit(x) for x in ("Lakers", "Celtics", "Bears", "Cubs", "Trail Blazers")]), (col % 5 + 1).cast("int"))
    did = F.element_at(F.array(*[F.lit(x) for x in ("trade star guard", "beat Celtics 110-102", "sign rookie to $15K deal", "lose knee back injury", "preview: how to watch", "will beat Bulls tonight", "set franchise record")]), (col % 7 + 1).cast("int"))
    return F.concat(who, F.lit(" "), did)


_SYNTH = "(['Lakers', 'Celtics', 'Bears', 'Cubs', 'Trail Blazers'][({0} % 5 + 1)::INT] || ' ' || ['trade star guard', 'beat Celtics 110-102', 'sign rookie to $15K deal', 'lose knee back injury', 'preview: how to watch', 'will beat Bulls tonight', 'set franchise record'][({0} % 7 + 1)::INT])"


def _event_sql() -> str:
    kinds = {}
    for kind, points, pattern in fixed.EVENT_RULES:
        p = _q(pattern.replace("(?! up)", ""))  # the guarded word does not occur in these headlines
        hits = f"least(3, len(list_distinct(regexp_extract_all(b, '({p})', 1))))" if points == 1 else f"regexp_matches(b, '{p}')::INT"
        kinds.setdefault(kind, []).append(f"{points} * {hits}")
    sums = ", ".join(f"{' + '.join(v)}{' + f' if k == 'preview' else ''} AS \"{k}\"" for k, v in kinds.items())
    rows = " UNION ALL ".join(
        f"SELECT id, '{k}' AS type, {i} AS rank, \"{k}\"{' + CASE WHEN s AND preview < 3 THEN 2 ELSE 0 END' if k == 'game-result' else ''} AS weight FROM w" for i, k in enumerate(fixed.EVENT_PRIORITY)
    )
    return f"""WITH h AS (SELECT o_orderkey AS id, {_SYNTH.format("o_orderkey")} AS h FROM orders), l AS (SELECT id, h, lower(h) AS l, regexp_matches(h, '\\d{{1,3}}-\\d{{1,3}}') AS s FROM h),
x AS (SELECT id, s, CASE WHEN regexp_matches(l, '{_q(fixed.FUTURE_RESULT)}') THEN 2 ELSE 0 END AS f, regexp_replace(l, '{_q(fixed.FUTURE_RESULT)}', ' ', 'g') AS b FROM l),
w AS (SELECT id, s, {sums} FROM x), r AS ({rows}), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, rank) AS n FROM r WHERE weight >= 2)
SELECT h.id, o.type AS event_type, o.weight::BIGINT AS weight FROM h LEFT JOIN o ON o.id = h.id AND o.n = 1"""


@query(_event_sql())
def event_rules(t):
    """Each wording is matched once, however many reports carry it."""
    h = t("orders").select(F.col("o_orderkey").alias("id"), _synthetic_headline(F.col("o_orderkey")).alias("h"))
    first = F.get(classify.event_types(F.col("h"), F.size(text.extract_scores(F.col("h"))) > 0), F.lit(0))
    typed = h.select("h").distinct().withColumn("e", first)
    return h.join(typed, "h").select("id", F.col("e.type").alias("event_type"), F.col("e.weight").cast("long").alias("weight"))


@query()
def classify_headlines(t):
    """Full classification of synthetic headlines: too many patterns for one SQL text; tests hold it against per-term search."""
    h = t("orders").select(F.col("o_orderkey").alias("id"), _synthetic_headline(F.col("o_orderkey")).alias("headline"))
    distinct = classify.classify(h.select("headline").distinct()).select("headline", "sport", "confidence")
    return h.join(distinct, "headline").select("id", "headline", "sport", "confidence")


_TERM_ROWS = ", ".join("(" + ", ".join(["'" + r[0] + "'", "'" + r[2] + "'", str(r[3]), "'" + r[4].replace("'", "''") + "'", str(r[6]).upper(), "'" + r[7].replace("'", "''") + "'" if r[7] else "NULL"]) + ")" for r in terms.dictionary_rows())


def _term_text(t) -> DataFrame:
    """Whole texts after a line in the lexicon's vocabulary, which they lack."""
    head = F.concat(_synthetic_headline(F.col("doc_id")), F.element_at(F.array(*[F.lit(x) for x in (" NBA lawyers", " nfl draft", " in the World Series", " at Special Olympics", " UFC title")]), (F.col("doc_id") % 5 + 1).cast("int")))
    return t("documents").select("doc_id", F.concat(head, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))


@query(
    f"""WITH terms(sport, tier, place, term, cased, guard) AS (VALUES {_TERM_ROWS}),
d AS (SELECT doc_id, regexp_replace({_SYNTH.format("doc_id")} || [' NBA lawyers', ' nfl draft', ' in the World Series', ' at Special Olympics', ' UFC title'][(doc_id % 5 + 1)::INT] || chr(10) || coalesce(text, ''), '(?i){"|".join(fixed.NEUTRAL_PHRASES)}', ' ', 'g') AS t FROM documents),
h AS (SELECT DISTINCT doc_id, sport, tier, place, term FROM d JOIN terms ON CASE WHEN cased THEN contains(t, term) ELSE contains(lower(t), lower(term)) END
  WHERE regexp_matches(CASE WHEN cased THEN t ELSE lower(t) END, '(^|[^\\p{{L}}\\p{{N}}])' || regexp_escape(CASE WHEN cased THEN term ELSE lower(term) END) || '($|[^\\p{{L}}\\p{{N}}])') AND (guard IS NULL OR NOT regexp_matches(t, guard)))
SELECT doc_id, sport, sum(CASE tier WHEN 'strong' THEN 3 WHEN 'team' THEN 2 ELSE 1 END)::BIGINT AS score, coalesce(string_agg(term, ',' ORDER BY place) FILTER (WHERE tier = 'strong'), '') AS strong,
  coalesce(string_agg(term, ',' ORDER BY place) FILTER (WHERE tier = 'team'), '') AS team, coalesce(string_agg(term, ',' ORDER BY place) FILTER (WHERE tier = 'weak'), '') AS weak FROM h GROUP BY doc_id, sport"""
)
def document_terms(t):
    """Evidence for each sport in whole documents, over the full lexicon."""
    found = terms.term_evidence(_term_text(t), "doc_id", "text")
    return found.select("doc_id", "sport", F.col("score").cast("long").alias("score"), *[F.array_join(c, ",").alias(c) for c in ("strong", "team", "weak")])


def _reports(t) -> DataFrame:
    """Candidates with their documents' own headlines; every third, and those whose first line is too long for a headline, with one in the
    lexicon's vocabulary, which event rules and teams know."""
    c = _cand(t)
    head = F.when((F.col("candidate_id") % 3 == 0) | (F.length("headline") > 220), _synthetic_headline(F.col("candidate_id"))).otherwise(F.col("headline"))
    sport = F.when(F.col("candidate_id") % 10 == 9, "unknown").otherwise("basketball")
    return c.select("candidate_id", head.alias("raw"), text.normalize_headline(head, unicode_form=False).alias("headline"), F.col("headline_kind").alias("kind"), sport.alias("sport"), F.lit(None).cast("string").alias("league"), "fresh_at")


_TEAMS = "[" + ", ".join("'" + t.lower().replace("'", "''") + "'" for t in dict.fromkeys(t.lower() for t in classify.team_terms())) + "]"
_KEYS = "[" + ", ".join("'" + classify.canonical_team(t).replace("'", "''") + "'" for t in dict.fromkeys(t.lower() for t in classify.team_terms())) + "]"
_PROPER = [(t, len(t) > 1 and t[0].isupper() and t[1].islower() and t[:2].isascii()) for t in classify.team_terms()]
_SPELLED = "[" + ", ".join("'" + (t if cased else t.lower()).replace("'", "''") + "'" for t, cased in _PROPER) + "]"
_CASED = "[" + ", ".join(str(cased).upper() for _, cased in _PROPER) + "]"
_OWN_KEYS = "[" + ", ".join("'" + classify.canonical_team(t).replace("'", "''") + "'" for t, _ in _PROPER) + "]"
_NEAR = (
    _CAND
    + rf""", rep AS (SELECT candidate_id, h AS raw, trim(regexp_replace(lower(replace(regexp_replace(h, '[‐-―−]', '-', 'g'), '…', '...')), '\s+', ' ', 'g')) AS headline, headline_kind AS kind, CASE WHEN candidate_id % 10 = 9 THEN 'unknown' ELSE 'basketball' END AS sport, fresh_at
  FROM (SELECT *, CASE WHEN candidate_id % 3 = 0 OR length(headline) > 220 THEN {_SYNTH.format("candidate_id")} ELSE headline END AS h FROM cand)),
title AS (SELECT * FROM rep WHERE kind = 'publisher-title'),
w AS (SELECT headline, {_GRAMS.format("headline")} AS grams, list_distinct(list_transform(list_filter(range(1, len({_TEAMS}) + 1), lambda i: contains(' ' || regexp_replace(headline, '[^\p{{L}}\p{{N}}]+', ' ', 'g') || ' ', ' ' || {_TEAMS}[i] || ' ')), lambda i: {_KEYS}[i])) AS teams
  FROM (SELECT DISTINCT headline FROM title)),
said AS (SELECT headline, list_distinct(flatten(list(list_transform(list_filter(range(1, len({_SPELLED}) + 1), lambda i: contains(CASE WHEN {_CASED}[i] THEN words ELSE lower(words) END, ' ' || {_SPELLED}[i] || ' ')), lambda i: {_OWN_KEYS}[i])))) AS own
  FROM (SELECT DISTINCT headline, ' ' || regexp_replace(raw, '[^\p{{L}}\p{{N}}]+', ' ', 'g') || ' ' AS words FROM title) GROUP BY headline),
pairs AS (SELECT a.headline AS a, b.headline AS b, len(list_intersect(a.grams, b.grams))::DOUBLE / len(list_distinct(list_concat(a.grams, b.grams))) AS similarity, list_has_any(said.own, b.teams) AS team FROM w a JOIN said ON said.headline = a.headline JOIN w b ON a.headline <> b.headline),
close AS (SELECT a, b, similarity FROM pairs WHERE similarity >= 0.3 OR team),
last AS (SELECT x.candidate_id, y.headline, max((epoch_us(y.fresh_at), y.candidate_id)) AS y, any_value(c.similarity) AS similarity FROM title x JOIN close c ON c.a = x.headline JOIN title y ON y.headline = c.b AND y.sport = x.sport
  AND (epoch_us(y.fresh_at), y.candidate_id) < (epoch_us(x.fresh_at), x.candidate_id) AND epoch_us(x.fresh_at) - epoch_us(y.fresh_at) <= {fixed.SEARCH_WINDOW_HOURS} * 3600000000 GROUP BY x.candidate_id, y.headline)
"""
)


_STOP = _LIST(sorted(set(fixed.NOT_NAMES.split())))


@query(
    rf"""WITH d AS (SELECT doc_id, string_split({_SYNTH.format("doc_id")} || [' NBA lawyers', ' nfl draft', ' in the World Series', ' at Special Olympics', ' UFC title'][(doc_id % 5 + 1)::INT] || chr(10) || coalesce(text, ''), chr(10)) AS s FROM documents),
l AS (SELECT doc_id, unnest(s) AS h, unnest(range(1, len(s) + 1)) AS line FROM d),
m AS (SELECT *, len(regexp_replace(h, '[^\p{{L}}]', '', 'g')) AS n, len(regexp_replace(h, '[^\p{{Lu}}]', '', 'g')) AS up, list_filter(regexp_split_to_array(h, '[\s\pZ]+'), lambda w: regexp_matches(w, '^\p{{L}}{{4}}')) AS long FROM l),
k AS (SELECT doc_id, line, CASE WHEN n >= 8 AND up >= 0.8 * n THEN list_aggregate(list_transform(string_split(lower(h), ''), lambda c, i: CASE WHEN i = 1 OR regexp_matches(lower(h)[i - 1], '[\s(-]') THEN upper(c) ELSE c END), 'string_agg', '') ELSE h END AS h
  FROM m WHERE NOT (len(long) >= 5 AND len(list_filter(long, lambda w: regexp_matches(w, '^\p{{Lu}}'))) > 0.7 * len(long))),
o AS (SELECT *, ' ' || regexp_replace(h, '[^\p{{L}}\p{{N}}]+', ' ', 'g') || ' ' AS said, regexp_split_to_array(h, '[\s\pZ]+') AS ws FROM k),
q AS (SELECT doc_id, line, ws, flatten(list_transform(list_filter(range(1, len({_SPELLED}) + 1), lambda i: contains(CASE WHEN {_CASED}[i] THEN said ELSE lower(said) END, ' ' || {_SPELLED}[i] || ' ')), lambda i: regexp_split_to_array({_OWN_KEYS}[i], '[ -]'))) AS of_teams FROM o),
w AS (SELECT doc_id, line, of_teams, unnest(ws) AS raw, unnest(range(1, len(ws) + 1)) AS i FROM q),
b AS (SELECT *, regexp_replace(raw, '^[("''“‘]+', '') AS bare FROM w),
t AS (SELECT *, regexp_replace(regexp_replace(strip_accents(lower(regexp_replace(bare, '[^\p{{L}}''’.-]', '', 'g'))), '[''’]s?$', ''), '\.+$', '') AS token FROM b),
f AS (SELECT doc_id, line, i, raw, token, regexp_matches(bare, '^\p{{Lu}}[\p{{L}}''’.-]') AND NOT regexp_matches(regexp_replace(bare, '[^\p{{L}}]', '', 'g'), '^\p{{Lu}}{{2,}}$') AND len(token) >= 3 AND NOT list_contains({_STOP}, token) AND NOT list_contains(of_teams, token) AS named FROM t),
g AS (SELECT *, NOT named OR lag(regexp_matches(raw, '[,:;!?]$'), 1, FALSE) OVER (PARTITION BY doc_id, line ORDER BY i) AS cut FROM f),
r AS (SELECT *, sum(cut::INT) OVER (PARTITION BY doc_id, line ORDER BY i) AS run FROM g),
u AS (SELECT doc_id, line, list_aggregate(list(token ORDER BY i)[1:3], 'string_agg', ' ') AS name FROM r WHERE named GROUP BY doc_id, line, run HAVING count(*) > 1)
SELECT doc_id, 'token' AS kind, token AS name, count(DISTINCT line) AS n_lines FROM f WHERE named GROUP BY doc_id, token
UNION ALL SELECT doc_id, 'full', name, count(DISTINCT line) FROM u GROUP BY doc_id, name
UNION ALL SELECT doc_id, 'surname', string_split(name, ' ')[-1], count(DISTINCT line) FROM u GROUP BY doc_id, string_split(name, ' ')[-1]"""
)
def document_names(t):
    """Names in every line of whole documents, with the number of lines that have them."""
    lines = _term_text(t).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    told = lambda kind, names: F.transform(names, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    of_kinds = lambda n: F.concat(told("token", n["tokens"]), told("full", n["full_names"]), told("surname", n["surnames"]))
    names = classify.extract_names(F.col("line"), classify.extract_teams(F.col("line")))
    return lines.select("doc_id", F.explode(text.bind(names, of_kinds)).alias("x")).groupBy("doc_id", "x.kind", "x.name").agg(F.count(F.lit(1)).alias("n_lines"))


@query(
    _NEAR
    + f"""SELECT candidate_id, neighbour_id, similarity, nth FROM (SELECT candidate_id, y[2] AS neighbour_id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY candidate_id ORDER BY similarity DESC, y[1] DESC, y[2]) AS nth FROM last) WHERE nth <= {fixed.NEIGHBOUR_LIMIT}"""
)
def near_reports(t):
    """Of each report the neighbours by words or teams: one for each other wording, at most NEIGHBOUR_LIMIT."""
    found = assignment.neighbours(storage.written(_reports(t)))
    return found.select("candidate_id", "neighbour_id", F.round("similarity", 6).alias("similarity"), F.col("nth").cast("long").alias("nth"))


def _scored_reports(t) -> tuple[DataFrame, DataFrame]:
    reports = storage.written(_reports(t))
    return reports, assignment.scored_neighbours(reports)


@query()
def pair_scores(t):
    """Evidence of each report and its neighbours; tests hold guards and scores against a plain version."""
    _, e = _scored_reports(t)
    return e.select("candidate_id", "neighbour_id", "agreement", F.transform("contradictions", lambda c: c["code"]).alias("contradictions"), "score", "confidence", "route")


@query()
def greedy_clusters(t):
    """Clusters as one walk from the oldest report on decides them; tests hold the rounds against such a walk."""
    reports, e = _scored_reports(t)
    types = classify.with_features(nearby.distinct(reports.select("raw")), "raw").select("raw", "features.event_type", "features.event_types")
    return assignment.assign(reports.join(types, "raw"), e).select("candidate_id", "cluster_id", "method", "score", F.size("near_misses").alias("near_misses"))


# --- clusters over orders ------------------------------------------------------------------------------------------------

_MEMBERS = """
WITH m AS (SELECT l_orderkey AS cluster_id, ((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 10000 + l_suppkey AS candidate_id, 's' || l_suppkey AS source, l_shipdate AS fresh_at,
  CASE l_returnflag WHEN 'A' THEN 'trade' WHEN 'R' THEN 'injury' END AS event_type, CASE l_linestatus WHEN 'F' THEN 'high' ELSE 'medium' END AS confidence,
  ['known', 'unknown', 'low-quality'][(l_suppkey % 3 + 1)::INT] AS quality, l_partkey % 10 <> 0 AS enabled, l_partkey, l_suppkey, l_linenumber FROM lineitem)
"""


def _members(t) -> DataFrame:
    c = F.col
    return t("lineitem").select(
        c("l_orderkey").alias("cluster_id"),
        (((c("l_orderkey") * 10 + c("l_linenumber")) * 1_000_000 + c("l_partkey")) * 10_000 + c("l_suppkey")).alias("candidate_id"),
        F.concat(F.lit("s"), c("l_suppkey").cast("string")).alias("source"),
        c("l_shipdate").cast("timestamp").alias("fresh_at"),
        F.when(c("l_returnflag") == "A", "trade").when(c("l_returnflag") == "R", "injury").alias("event_type"),
        F.when(c("l_linestatus") == "F", "high").otherwise("medium").alias("confidence"),
        F.element_at(F.array(F.lit("known"), F.lit("unknown"), F.lit("low-quality")), (c("l_suppkey") % 3 + 1).cast("int")).alias("quality"),
        (c("l_partkey") % 10 != 0).alias("enabled"),
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
    )


def _profiled_members(t) -> DataFrame:
    n, part = F.col("l_linenumber"), F.col("l_partkey") % 3
    return _members(t).withColumns(
        {
            "discovered_at": F.col("fresh_at"),
            "published_at": F.when(n % 3 > 0, F.timestamp_micros(F.unix_micros("fresh_at") - n.cast("long") * 3_600_000_000)),
            "sport": F.concat(F.lit("sport"), (F.col("l_suppkey") % 4).cast("string")),
            "league": F.when(part > 0, F.concat(F.lit("league"), part.cast("string"))),
        }
    )


@query(
    _MEMBERS
    + """, n AS (SELECT cluster_id, event_type, count(*) AS n FROM m WHERE event_type IS NOT NULL GROUP BY ALL),
mo AS (SELECT cluster_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, event_type) AS r FROM n) WHERE r = 1)
SELECT m.cluster_id, count(*) AS candidate_count, count(DISTINCT source) AS source_count, epoch_us(min(fresh_at)) AS first_seen_at, epoch_us(max(fresh_at)) AS last_seen_at,
  CASE WHEN count(*) FILTER (WHERE confidence = 'medium') > 0 THEN 'medium' ELSE 'high' END AS confidence, any_value(mo.event_type) AS event_type
FROM m LEFT JOIN mo ON mo.cluster_id = m.cluster_id GROUP BY m.cluster_id"""
)
def cluster_aggregate(t):
    found = clustering.cluster_aggregates(_profiled_members(t))
    return found.select("cluster_id", "candidate_count", "source_count", _micros("first_seen_at"), _micros("last_seen_at"), "confidence", "event_type")


_MODE = lambda c: f"SELECT cluster_id, {c} FROM (SELECT cluster_id, {c}, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, {c}) AS r FROM p WHERE {c} IS NOT NULL GROUP BY cluster_id, {c}) WHERE r = 1"


@query(
    _MEMBERS
    + f""", p AS (SELECT *, CASE WHEN l_linenumber % 3 > 0 THEN fresh_at - to_hours(l_linenumber) END AS published_at, 'sport' || l_suppkey % 4 AS sport, CASE WHEN l_partkey % 3 > 0 THEN 'league' || l_partkey % 3 END AS league FROM m),
s AS ({_MODE("sport")}), l AS ({_MODE("league")})
SELECT p.cluster_id, any_value(s.sport) AS sport, any_value(l.league) AS league, epoch_us(min(published_at)) AS first_published_at, epoch_us(max(published_at)) AS last_published_at
FROM p LEFT JOIN s ON s.cluster_id = p.cluster_id LEFT JOIN l ON l.cluster_id = p.cluster_id GROUP BY p.cluster_id"""
)
def cluster_profile(t):
    return clustering.cluster_aggregates(_profiled_members(t)).select("cluster_id", "sport", "league", _micros("first_published_at"), _micros("last_published_at"))


@query(
    _CAND
    + r""", s AS (SELECT *, count(*) OVER (PARTITION BY normalized_headline, source) AS share, ['known', 'unknown', 'low-quality'][(candidate_id % 3 + 1)::INT] AS quality FROM cand WHERE headline_kind = 'publisher-title'),
r AS (SELECT *, row_number() OVER (PARTITION BY normalized_headline ORDER BY
  (length(headline) BETWEEN 20 AND 220 AND NOT regexp_matches(headline, '(\.\.\.|…)\s*$') AND NOT regexp_matches(headline, '\s[–—|]\s[^–—|]{2,60}$')) DESC, enabled DESC, CASE quality WHEN 'known' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END DESC,
  CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, published_at IS NOT NULL DESC, share, published_at NULLS LAST, candidate_id, headline) AS n FROM s)
SELECT normalized_headline AS cluster_id, candidate_id, headline FROM r WHERE n = 1"""
)
def representative_pick(t):
    quality = F.element_at(F.array(F.lit("known"), F.lit("unknown"), F.lit("low-quality")), (F.col("candidate_id") % 3 + 1).cast("int"))
    return clustering.representatives(_cand(t).withColumn("cluster_id", F.col("normalized_headline")).withColumn("quality", quality))


_CLUSTERS = """
WITH cl AS (SELECT o_orderkey AS cluster_id, o_orderdate AS last_seen_at, CASE o_orderstatus WHEN 'F' THEN 'stable' WHEN 'O' THEN 'open' ELSE 'needs_review' END AS status,
  CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey + 1 END AS merged_into_id FROM orders)
"""


def _clusters(t) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "stable").when(F.col("o_orderstatus") == "O", "open").otherwise("needs_review")
    return t("orders").select(F.col("o_orderkey").alias("cluster_id"), F.col("o_orderdate").cast("timestamp").alias("last_seen_at"), status.alias("status"), F.when(F.col("o_orderkey") % 50 == 0, F.col("o_orderkey") + 1).alias("merged_into_id"))


@query(
    _CLUSTERS
    + """SELECT cluster_id, CASE WHEN merged_into_id IS NULL AND status IN ('open', 'stable') AND last_seen_at < TIMESTAMP '2001-07-01' - INTERVAL 72 HOURS THEN 'closed'
WHEN merged_into_id IS NULL AND status = 'open' AND last_seen_at < TIMESTAMP '2001-07-01' - INTERVAL 24 HOURS THEN 'stable' ELSE status END AS status FROM cl"""
)
def cluster_age_out(t):
    return clustering.age_out(_clusters(t), F.lit("2001-07-01").cast("timestamp")).select("cluster_id", "status")


@query(
    _MEMBERS
    + """, g AS (SELECT o_orderkey AS f, CASE WHEN o_orderkey % 20 = 0 THEN o_orderkey + 1 WHEN o_orderkey % 20 = 1 THEN o_orderkey + 1 END AS i FROM orders)
SELECT candidate_id, coalesce(g2.i, g1.i, m.cluster_id) AS cluster_id FROM m LEFT JOIN g g1 ON g1.f = m.cluster_id AND g1.i IS NOT NULL LEFT JOIN g g2 ON g2.f = g1.i AND g2.i IS NOT NULL"""
)
def cluster_merge(t):
    o = F.col("o_orderkey")
    merges = t("orders").filter(o % 20 <= 1).select(o.alias("from_id"), (o + 1).alias("into_id"))
    return clustering.merge_clusters(_members(t).select("candidate_id", "cluster_id"), merges).select("candidate_id", "cluster_id")


@query(
    _MEMBERS
    + """, a AS (SELECT candidate_id, CASE WHEN l_linenumber % 2 = 0 THEN cluster_id ELSE cluster_id + 1 END AS cluster_id, CASE WHEN l_partkey % 4 = 0 THEN fresh_at END AS dismissed_at FROM m WHERE l_suppkey % 5 = 0)
SELECT a.candidate_id, a.cluster_id, m.cluster_id AS current_cluster_id FROM a JOIN m USING (candidate_id) WHERE dismissed_at IS NULL AND a.cluster_id <> m.cluster_id"""
)
def review_queue(t):
    m = _members(t)
    a = m.filter("l_suppkey % 5 = 0").select(
        "candidate_id", F.when(F.col("l_linenumber") % 2 == 0, F.col("cluster_id")).otherwise(F.col("cluster_id") + 1).alias("cluster_id"), F.when(F.col("l_partkey") % 4 == 0, F.col("fresh_at")).alias("dismissed_at")
    )
    return clustering.review_queue(a, m).select("candidate_id", "cluster_id", "current_cluster_id")


# --- ranking -------------------------------------------------------------------------------------------------------------

_SIGNALS = (
    _MEMBERS
    + """, d AS (SELECT cluster_id, source, min(fresh_at) AS first_at, arg_min(quality, (fresh_at, quality)) AS quality FROM m WHERE enabled GROUP BY ALL),
sig AS (SELECT o_orderkey AS cluster_id, count(source) AS domains, count(*) FILTER (WHERE quality = 'known') AS known_domains,
  count(*) FILTER (WHERE source IS NOT NULL AND epoch_us(o_orderdate) + 30 * 86400::BIGINT * 1000000 - epoch_us(first_at) <= 15 * 86400::BIGINT * 1000000) AS last_15m,
  count(*) FILTER (WHERE source IS NOT NULL AND epoch_us(o_orderdate) + 30 * 86400::BIGINT * 1000000 - epoch_us(first_at) <= 60 * 86400::BIGINT * 1000000) AS last_hour,
  any_value(o_orderpriority) AS pri, any_value(o_totalprice) AS price, any_value(o_custkey) AS cust, any_value(o_orderdate) AS od
  FROM orders LEFT JOIN d ON d.cluster_id = o_orderkey GROUP BY o_orderkey),
typed AS (SELECT *, CASE pri WHEN '1-URGENT' THEN 'trade' WHEN '2-HIGH' THEN 'game-result' WHEN '3-MEDIUM' THEN 'preview' WHEN '4-NOT SPECIFIED' THEN 'injury' END AS event_type,
  ['basketball', 'football', 'baseball', 'boxing', 'soccer', 'golf'][(cust % 6 + 1)::INT] AS sport, (cluster_id % 40)::DOUBLE AS latest_hours, (cluster_id % 60)::DOUBLE AS event_hours FROM sig)
"""
)


def _signals(t) -> DataFrame:
    """Signals a cluster: orders as clusters, suppliers as publishers, days as minutes."""
    m = _members(t)
    reports = m.filter("enabled").groupBy("cluster_id", "source").agg(F.min("fresh_at").alias("first_at"), F.min_by("quality", F.struct("fresh_at", "quality")).alias("quality"))
    o = t("orders").select(F.col("o_orderkey").alias("cluster_id"), F.col("o_orderdate").cast("timestamp").alias("od"), F.col("o_orderpriority").alias("pri"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("cust"))
    age = F.unix_micros("od") + F.lit(30 * 86400 * 1_000_000) - F.unix_micros("first_at")
    day = 86400 * 1_000_000
    sig = (
        o.join(reports, "cluster_id", "left")
        .groupBy("cluster_id", "od", "pri", "price", "cust")
        .agg(F.count("source").alias("domains"), F.count_if(F.col("quality") == "known").alias("known_domains"), F.count_if(age <= 15 * day).alias("last_15m"), F.count_if(age <= 60 * day).alias("last_hour"))
    )
    kind = ranking.lookup({"1-URGENT": "trade", "2-HIGH": "game-result", "3-MEDIUM": "preview", "4-NOT SPECIFIED": "injury"}, F.col("pri"))
    sport = F.element_at(F.array(*[F.lit(s) for s in ("basketball", "football", "baseball", "boxing", "soccer", "golf")]), (F.col("cust") % 6 + 1).cast("int"))
    return sig.withColumns({"event_type": kind, "sport": sport, "latest_hours": (F.col("cluster_id") % 40).cast("double"), "event_hours": (F.col("cluster_id") % 60).cast("double")})


_LOG = "CASE WHEN {0} <= 1 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, ln({0}::DOUBLE) / ln({1}::DOUBLE)) END"
_BREADTH = f"round(34 * ({_LOG.format('domains', 20)}) * CASE event_type WHEN 'game-result' THEN 0.55::DOUBLE WHEN 'preview' THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END, 6)"
_VELOCITY = "CASE WHEN domains < 2 OR last_hour = 0 THEN 0.0::DOUBLE ELSE (least(4, last_15m) * 5 + least(5, last_hour - last_15m) * 2) * CASE event_type WHEN 'game-result' THEN 0.4::DOUBLE WHEN 'preview' THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END END"


@query(_SIGNALS + f"SELECT cluster_id, domains, known_domains, {_BREADTH} AS breadth, round({_VELOCITY}, 6) AS velocity FROM typed")
def breadth_velocity(t):
    b = ranking.breadth(F.col("domains"), F.lit(1), F.col("known_domains"), F.lit(1), F.col("event_type"))
    v = ranking.velocity(F.col("domains"), F.col("last_15m"), F.col("last_hour"), F.col("event_type"))
    return _signals(t).select("cluster_id", "domains", "known_domains", F.round(b["domains"], 6).alias("breadth"), F.round(v, 6).alias("velocity"))


_RECENCY = "60 * (0.5::DOUBLE * pow(0.5::DOUBLE, latest_hours / 6.0::DOUBLE) + 0.5::DOUBLE * pow(0.5::DOUBLE, event_hours / 10.0::DOUBLE))"


@query(_SIGNALS + f"SELECT cluster_id, round({_RECENCY}, 6) AS recency FROM typed")
def recency_half_life(t):
    return _signals(t).select("cluster_id", F.round(times.recency_points(F.col("latest_hours"), F.col("event_hours")), 6).alias("recency"))


_IMPORTANCE = "CASE coalesce(event_type, 'unknown') " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.EVENT_IMPORTANCE.items()) + " END"
_CORROBORATED = f"(CASE WHEN {_IMPORTANCE} <= 0 THEN ({_IMPORTANCE})::DOUBLE ELSE {_IMPORTANCE} * CASE WHEN domains >= 3 THEN 1.0::DOUBLE WHEN domains = 2 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END END)"


@query(_SIGNALS + f"SELECT cluster_id, round({_CORROBORATED}, 4) AS importance, CASE WHEN sport IN ('basketball', 'football', 'baseball') THEN 'unspecified-major' ELSE 'professional' END AS tier FROM typed")
def tier_importance(t):
    s = _signals(t)
    tier = ranking.infer_tier(F.lit(None).cast("string"), F.col("sport"), F.array().cast("array<string>"), F.lit(False))
    return s.select("cluster_id", F.round(ranking.corroborated(ranking.importance(F.col("event_type")), F.col("domains")), 4).alias("importance"), tier.alias("tier"))


_URGENCY = """CASE WHEN event_type IS NULL OR event_type NOT IN ('trade', 'injury') OR domains < 2 THEN 'normal' WHEN latest_hours <= 2 AND last_hour >= 2 THEN 'breaking-candidate'
WHEN latest_hours <= 6 THEN 'developing' ELSE 'normal' END"""
_SECTIONS = (
    _SIGNALS
    + f""", u AS (SELECT *, {_URGENCY} AS urgency FROM typed)
, sec AS (SELECT *, latest_hours <= 12 AND coalesce(event_type, 'unknown') <> 'preview' AND (domains >= 3 OR (domains >= 2 AND {_IMPORTANCE} >= 40))
    AND NOT (coalesce(event_type, '') = 'game-result' AND domains < 12) AS lead_ok,
  coalesce(event_type, 'unknown') <> 'preview' AND domains >= 2 AND latest_hours <= 6 AND (urgency <> 'normal' OR (domains >= 4 AND last_hour >= 2 AND coalesce(event_type, '') IN ('trade', 'injury'))) AS wire_ok,
  coalesce(event_type, 'unknown') <> 'preview' AND (domains >= 2 OR coalesce(event_type, '') IN ('trade', 'injury')) AS desk_ok FROM u)
"""
)


def _sectioned(t) -> DataFrame:
    s = _signals(t).withColumns({"confidence": F.lit("high"), "speculative": F.lit(False), "stakes": F.lit(False), "state": F.lit("eligible"), "headline_ok": F.lit(True), "members": F.lit(1), "better_members": F.lit(1)})
    s = s.withColumn("urgency", ranking.urgency(F.col("event_type"), F.col("latest_hours"), F.col("domains"), F.col("last_hour"), F.col("confidence"), F.col("speculative")))
    return ranking.sections(s)


@query(
    _SECTIONS
    + """SELECT cluster_id, urgency, lead_ok, wire_ok, desk_ok, desk_ok AND latest_hours <= 12 AS now_ok,
CASE sport WHEN 'basketball' THEN 'run' WHEN 'football' THEN 'huddle' WHEN 'baseball' THEN 'diamond' WHEN 'boxing' THEN 'fight-desk' WHEN 'soccer' THEN 'world-game' ELSE 'across-the-board' END AS desk FROM sec"""
)
def urgency_sections(t):
    return _sectioned(t).select("cluster_id", "urgency", "lead_ok", "wire_ok", "desk_ok", "now_ok", ranking.desk(F.col("sport")).alias("desk"))


_SPORT_W = "CASE sport " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixed.SPORT_WEIGHT.items()) + " END"


def _scored(t) -> DataFrame:
    """Clusters with exactly representable scores, so that both engines order them alike."""
    s = _sectioned(t)
    points = ranking.lookup(fixed.SPORT_WEIGHT, F.col("sport"), 0) + ranking.importance(F.col("event_type")) + 5 * F.col("domains") - F.floor("latest_hours")
    state = F.when(F.col("cluster_id") % 9 == 0, "ineligible").otherwise("eligible")
    return s.withColumns({"score": points.cast("double"), "state": state, "newest_at": F.col("od")})


@query(
    _SECTIONS
    + f""", sc AS (SELECT *, ({_SPORT_W} + {_IMPORTANCE} + 5 * domains - floor(latest_hours))::DOUBLE AS score, CASE WHEN cluster_id % 9 = 0 THEN 'ineligible' ELSE 'eligible' END AS state FROM sec),
o AS (SELECT cluster_id, row_number() OVER (ORDER BY score DESC, {_SPORT_W} DESC, od DESC, cluster_id) AS position FROM sc WHERE state <> 'ineligible')
SELECT sc.cluster_id, score, CASE WHEN score >= 210 THEN 1 WHEN score >= 170 THEN 2 WHEN score >= 130 THEN 3 ELSE 4 END AS priority, o.position FROM sc LEFT JOIN o USING (cluster_id)"""
)
def ranked_positions(t):
    return ranking.rank(_scored(t)).select("cluster_id", "score", ranking.priority(F.col("score")).alias("priority"), "position")


@query(
    """WITH l AS (SELECT o_custkey % 300 AS item_id, CASE o_orderkey % 3 WHEN 0 THEN 'pin' WHEN 1 THEN 'boost' ELSE 'suppress' END AS kind, (o_orderkey % 500)::DOUBLE AS amount, o_orderdate AS created_at, o_orderkey AS override_id,
  CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS removed_at FROM orders),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, kind ORDER BY created_at DESC, override_id DESC) AS n FROM l) WHERE n = 1 AND removed_at IS NULL)
SELECT item_id, count(*) AS overrides, sum(CASE kind WHEN 'pin' THEN 1000 WHEN 'boost' THEN least(300, amount) ELSE -amount END)::DOUBLE AS points FROM a GROUP BY item_id"""
)
def override_scores(t):
    o = F.col("o_orderkey")
    log = t("orders").select(
        (F.col("o_custkey") % 300).alias("item_id"), F.when(o % 3 == 0, "pin").when(o % 3 == 1, "boost").otherwise("suppress").alias("kind"), (o % 500).cast("double").alias("amount"),
        F.col("o_orderdate").alias("created_at"), o.alias("override_id"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("removed_at"),
    )
    items = ranking.active_overrides(log).groupBy("item_id").agg(F.collect_list(F.struct("kind", "amount")).alias("overrides"))
    empty = F.array().cast("array<struct<key: string, points: double>>")
    return ranking.apply_overrides(items.withColumn("parts", empty)).select("item_id", F.size("overrides").cast("long").alias("overrides"), F.col("score").alias("points"))


@query()
def slate_diverse(t):
    """Sections under diversity limits; each choice depends on those before it (tests compare with hand-made cases)."""
    s = _scored(t).withColumns(
        {
            "edition": F.date_format("od", "yyyy-MM"), "headline": F.concat(F.lit("story "), F.col("cluster_id").cast("string")), "item_status": F.lit("suggested"), "pinned": F.col("cluster_id") % 997 == 0,
            "forced_section": F.lit(None).cast("string"), "entities": F.array(F.concat(F.lit("team:"), F.col("cust").cast("string"))), "tokens": F.array(F.col("cluster_id").cast("string")),
            "teams": F.array(F.col("cust").cast("string")), "desk": ranking.desk(F.col("sport")),
        }
    )
    return slate.build_slates(s)


@query(
    _MEMBERS
    + """, e AS (SELECT *, l_linenumber = 2 AS rep FROM m WHERE enabled), p AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, source ORDER BY rep DESC, fresh_at, candidate_id) AS k FROM e)
SELECT cluster_id, source, candidate_id, row_number() OVER (PARTITION BY cluster_id ORDER BY rep DESC, CASE quality WHEN 'known' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END, fresh_at, source) AS nth FROM p WHERE k = 1"""
)
def supporting_sources(t):
    m = _members(t).withColumns({"domain": F.col("source"), "is_representative": F.col("l_linenumber") == 2, "reported_at": F.col("fresh_at")})
    return ranking.supporting_sources(m).select("cluster_id", "source", "candidate_id", F.col("nth").cast("long").alias("nth"))


@query(
    """WITH s AS (SELECT o_orderkey AS cluster_id, o_orderpriority AS headline, o_totalprice AS score, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'candidate' ELSE 'held' END AS status FROM orders WHERE o_orderkey % 3 <> 0),
f AS (SELECT o_orderkey AS cluster_id, CASE WHEN o_orderkey % 5 = 0 THEN 'new ' || o_orderpriority ELSE o_orderpriority END AS headline, o_totalprice + 1 AS score, CASE o_custkey % 3 WHEN 0 THEN 'eligible' WHEN 1 THEN 'review' ELSE 'ineligible' END AS eligibility FROM orders WHERE o_orderkey % 4 <> 0)
SELECT coalesce(s.cluster_id, f.cluster_id) AS cluster_id, CASE WHEN f.cluster_id IS NOT NULL THEN f.headline ELSE s.headline END AS headline, CASE WHEN f.cluster_id IS NOT NULL THEN f.score ELSE s.score END AS score,
  CASE WHEN s.cluster_id IS NULL THEN CASE WHEN f.eligibility = 'review' THEN 'review' ELSE 'candidate' END WHEN s.status = 'approved' AND f.cluster_id IS NOT NULL AND s.headline IS DISTINCT FROM f.headline THEN 'review' ELSE s.status END AS status
FROM s FULL JOIN f ON s.cluster_id = f.cluster_id"""
)
def editorial_upsert(t):
    o = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "candidate").otherwise("held")
    stored = t("orders").filter(o % 3 != 0).select(o.alias("cluster_id"), F.col("o_orderpriority").alias("headline"), F.col("o_totalprice").alias("score"), status.alias("status"))
    head = F.when(o % 5 == 0, F.concat(F.lit("new "), F.col("o_orderpriority"))).otherwise(F.col("o_orderpriority"))
    fresh = t("orders").filter(o % 4 != 0).select(o.alias("cluster_id"), head.alias("headline"), (F.col("o_totalprice") + 1).alias("score"), F.when(F.col("o_custkey") % 3 == 0, "eligible").when(F.col("o_custkey") % 3 == 1, "review").otherwise("ineligible").alias("eligibility"))
    return ranking.upsert_items(stored, fresh)


_STORY = """
WITH st AS (SELECT o_orderkey AS story_id, ['basketball', 'football', 'baseball', 'boxing', 'soccer', 'golf', 'other'][(o_custkey % 7 + 1)::INT] AS sport, ['professional', 'international', 'college', 'other'][(o_orderkey % 4 + 1)::INT] AS tier,
  ['breaking', 'developing', 'none'][(o_orderkey % 3 + 1)::INT] AS urgency, ['staff', 'wire', 'syndicated', 'aggregated'][(o_custkey % 4 + 1)::INT] AS credibility, (o_orderkey % 3)::INT AS significance, (o_custkey % 15)::INT AS source_count,
  o_orderkey % 500 = 0 AS pinned, CASE WHEN o_orderkey % 400 = 1 THEN 77 END AS manual_override, epoch_us(TIMESTAMP '2001-08-02') - epoch_us(o_orderdate) AS age FROM orders)
"""


def _stories(t) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (n + 1).cast("int"))
    return t("orders").select(
        o.alias("story_id"), pick(["basketball", "football", "baseball", "boxing", "soccer", "golf", "other"], c % 7).alias("sport"), pick(list(fixed.LEGACY_TIER), o % 4).alias("tier"),
        pick(list(fixed.LEGACY_URGENCY), o % 3).alias("urgency"), pick(list(fixed.LEGACY_CREDIBILITY), c % 4).alias("credibility"), (o % 3).cast("int").alias("significance"), (c % 15).cast("int").alias("source_count"),
        (o % 500 == 0).alias("pinned"), F.when(o % 400 == 1, 77).alias("manual_override"), F.col("o_orderdate").cast("timestamp").alias("published_at"), F.lit(None).cast("timestamp").alias("updated_at"),
        pick(["report", "analysis", "visual-feature"], o % 3).alias("story_type"), F.date_format(F.col("o_orderdate"), "yyyy-MM").alias("edition"),
    )


@query(
    _STORY
    + """SELECT story_id, round(coalesce(manual_override::DOUBLE, CASE sport WHEN 'basketball' THEN 100 WHEN 'football' THEN 95 WHEN 'baseball' THEN 90 WHEN 'boxing' THEN 70 WHEN 'soccer' THEN 70 WHEN 'golf' THEN 55 ELSE 45 END
* CASE tier WHEN 'professional' THEN 1.0::DOUBLE WHEN 'international' THEN 0.92::DOUBLE WHEN 'college' THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END + greatest(0.0::DOUBLE, 36 - age / 3.6e9::DOUBLE)
+ CASE urgency WHEN 'breaking' THEN 40 WHEN 'developing' THEN 20 ELSE 0 END + CASE credibility WHEN 'staff' THEN 10 WHEN 'wire' THEN 6 WHEN 'syndicated' THEN 3 ELSE 0 END
+ 20 * significance + 1.5::DOUBLE * least(source_count, 10) + CASE WHEN pinned THEN 100000 ELSE 0 END), 6) AS score FROM st"""
)
def legacy_story_score(t):
    s = _stories(t)
    return s.select("story_id", F.round(slate.story_score(s, F.lit("2001-08-02").cast("timestamp")), 6).alias("score"))


@query()
def legacy_homepage(t):
    """Homepages by month; every section depends on what earlier ones used."""
    s = _stories(t)
    return slate.build_homepages(s.withColumn("score", slate.story_score(s, F.lit("2001-08-02").cast("timestamp"))))


# --- health and time -----------------------------------------------------------------------------------------------------


_RUNS = """
WITH runs AS (SELECT user_id AS provider, event_id AS run_id, ts, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' WHEN 'view' THEN 'partial' ELSE 'succeeded' END AS status,
  CASE WHEN event_type = 'error' THEN 'error' WHEN value < 25 THEN 'empty' WHEN value > 80 THEN 'throttled' ELSE 'ok' END AS provider_state, event_id % 50 AS returned,
  ts + to_minutes(event_id % 7) AS finished_at, CASE WHEN event_type = 'error' THEN 'code ' || event_id % 5 END AS error_message FROM events WHERE event_id % 11 <> 0),
f AS (SELECT *, sum((status <> 'running')::INT) OVER (PARTITION BY provider ORDER BY ts DESC, run_id DESC) AS k FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY ts DESC, run_id DESC) AS n FROM runs) WHERE n <= 30),
g AS (SELECT provider, count(*) FILTER (WHERE status <> 'running') AS done, count(*) AS runs,
  coalesce(min(k) FILTER (WHERE status <> 'running' AND status <> 'failed') - 1, done)::BIGINT AS failures, coalesce(min(k) FILTER (WHERE status <> 'running' AND provider_state <> 'throttled') - 1, done)::BIGINT AS throttles,
  coalesce(min(k) FILTER (WHERE status <> 'running' AND provider_state <> 'empty') - 1, done)::BIGINT AS empties,
  arg_min(finished_at, k) FILTER (WHERE status IN ('succeeded', 'partial') AND provider_state IN ('ok', 'empty')) AS last_success_at,
  arg_min(status, k) FILTER (WHERE status <> 'running') AS latest_status, arg_min(error_message, k) FILTER (WHERE status <> 'running' AND error_message IS NOT NULL) AS latest_error FROM f GROUP BY provider)
"""


def _runs(t) -> DataFrame:
    kind, i = F.col("event_type"), F.col("event_id")
    at = F.col("ts").cast("timestamp")
    return t("events").filter(i % 11 != 0).select(
        F.col("user_id").alias("provider"), i.alias("run_id"), at.alias("ts"), F.when(kind == "error", "failed").when(kind == "signup", "running").when(kind == "view", "partial").otherwise("succeeded").alias("status"),
        F.when(kind == "error", "error").when(F.col("value") < 25, "empty").when(F.col("value") > 80, "throttled").otherwise("ok").alias("provider_state"), (i % 50).alias("returned"),
        F.timestamp_micros(F.unix_micros(at) + (i % 7) * 60_000_000).alias("finished_at"), F.when(kind == "error", F.concat(F.lit("code "), (i % 5).cast("string"))).alias("error_message"),
    )


@query(_RUNS + "SELECT provider, failures, throttles, empties, epoch_us(last_success_at) AS last_success_at, latest_status, latest_error, runs FROM g")
def run_streaks_health(t):
    s = health.leading_streaks(_runs(t), "provider", "ts")
    return s.select("provider", "failures", "throttles", "empties", _micros("last_success_at"), "latest_status", F.col("latest_error.message").alias("latest_error"), "runs")


@query(_RUNS + "SELECT provider, count(*) AS recent_runs, sum(returned)::BIGINT AS recent_returned FROM runs WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 60 MINUTES GROUP BY provider")
def recent_run_totals(t):
    return health.recent_totals(_runs(t), "provider", "ts", F.lit("2024-01-20").cast("timestamp"))


@query(
    _RUNS
    + """, p AS (SELECT *, CASE WHEN provider % 13 = 0 THEN 'disabled' WHEN provider % 13 = 1 THEN 'degraded' WHEN provider % 13 < 9 THEN 'active' END AS db_status, provider % 17 <> 0 AS schedulable, 600 + provider % 5 * 300 AS stale_minutes, 2 + provider % 2 AS down_failures,
  CASE WHEN provider % 3 > 0 THEN provider % 3 END AS degraded_empties, CASE WHEN provider % 4 = 0 THEN provider % 9 END AS lag_files FROM (SELECT DISTINCT user_id AS provider FROM events UNION SELECT -1)),
j AS (SELECT p.*, coalesce(failures, 0) AS f, coalesce(throttles, 0) AS th, coalesce(empties, 0) AS em, coalesce(runs, 0) AS n, latest_status, floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(last_success_at)) / 6e7) AS since FROM p LEFT JOIN g USING (provider)),
s AS (SELECT *, db_status IS NOT DISTINCT FROM 'disabled' AS off, since IS NULL OR since > stale_minutes AS quiet, coalesce(lag_files >= 6, false) AS lagging,
  list_filter([CASE WHEN db_status = 'degraded' THEN 'marked-degraded' END, CASE WHEN latest_status = 'partial' THEN 'partial' END, CASE WHEN f >= 1 THEN 'failures' END, CASE WHEN th >= 1 THEN 'throttles' END,
  CASE WHEN em >= degraded_empties THEN 'empties' END, CASE WHEN lag_files >= 3 THEN 'lag' END], lambda x: x IS NOT NULL) AS faults FROM j),
st AS (SELECT *, CASE WHEN off OR NOT schedulable THEN 'disabled' WHEN n = 0 THEN 'unknown' WHEN f >= down_failures THEN 'down' WHEN quiet OR lagging THEN 'stale' WHEN len(faults) > 0 THEN 'degraded' ELSE 'healthy' END AS state FROM s)
SELECT provider, state, array_to_string(CASE WHEN off THEN ['switched-off'] WHEN NOT schedulable THEN ['not-schedulable'] WHEN n = 0 THEN ['never-run'] WHEN f >= down_failures THEN ['failures']
  WHEN quiet OR lagging THEN list_filter([CASE WHEN quiet THEN 'no-success' END, CASE WHEN lagging THEN 'lag' END], lambda x: x IS NOT NULL) WHEN len(faults) > 0 THEN faults ELSE ['recent-success'] END, ',') AS reasons,
  array_to_string(list_filter([CASE WHEN off THEN 'provider-disabled:info' END, CASE WHEN NOT off AND schedulable AND n = 0 THEN 'provider-never-run:info' END, CASE WHEN state = 'down' THEN 'provider-down:critical' END, CASE WHEN state = 'stale' THEN 'provider-stale:critical' END,
  CASE WHEN NOT off AND schedulable AND f >= 2 THEN CASE WHEN f >= down_failures THEN 'consecutive-failures:critical' ELSE 'consecutive-failures:warning' END END, CASE WHEN NOT off AND schedulable AND th >= 2 THEN 'consecutive-throttles:warning' END,
  CASE WHEN NOT off AND schedulable AND lag_files >= 3 THEN CASE WHEN lagging THEN 'gkg-file-lag:critical' ELSE 'gkg-file-lag:warning' END END], lambda x: x IS NOT NULL), ',') AS alerts FROM st"""
)
def provider_health_states(t):
    """State, reasons and alerts of providers with all settings."""
    k = F.col("provider")
    p = t("events").select(F.col("user_id").alias("provider")).distinct().union(t("events").sparkSession.range(1).select(F.lit(-1).cast("long")))
    p = p.withColumns(
        {
            "db_status": F.when(k % 13 == 0, "disabled").when(k % 13 == 1, "degraded").when(k % 13 < 9, "active"), "schedulable": k % 17 != 0, "stale_minutes": 600 + k % 5 * 300, "down_failures": 2 + k % 2,
            "degraded_empties": F.when(k % 3 > 0, k % 3), "lag_files": F.when(k % 4 == 0, k % 9), "lag_degraded": F.lit(3), "lag_stale": F.lit(6),
        }
    )
    found = health.provider_health(p, _runs(t), "provider", "ts", _now())
    alerts = F.array_join(F.transform("alerts", lambda a: F.concat_ws(":", a["code"], a["severity"])), ",")
    return found.select("provider", "state", F.array_join("reasons", ",").alias("reasons"), alerts.alias("alerts"))


@query(
    """WITH e AS (SELECT event_id, epoch_us(ts) // 900000000 AS processed, epoch_us(ts) // 900000000 + event_id % 4 AS expected, epoch_us(ts) // 900000000 + event_id % 3 AS available FROM events)
SELECT event_id, processed * 900000000 AS boundary, greatest(0, expected - processed)::BIGINT AS steps,
  CASE WHEN expected - processed = 0 THEN 'none' WHEN processed >= available THEN 'upstream-late' ELSE 'ingest-behind' END AS cause FROM e"""
)
def gkg_lag(t):
    at = times.quarter_hour(F.col("ts").cast("timestamp"))
    later = lambda n: F.timestamp_micros((F.unix_micros(at) + n * 900_000_000).cast("long"))
    e = t("events").select("event_id", F.unix_micros(at).alias("boundary"), health.file_lag(later(F.col("event_id") % 4), later(F.col("event_id") % 3), at).alias("lag"))
    return e.select("event_id", "boundary", F.col("lag.steps").cast("long").alias("steps"), "lag.cause")


@query(
    """SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS parent_turn FROM conversations"""
)
def parent_carry_forward(t):
    w = Window.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(Window.unboundedPreceding, 0)
    return t("conversations").select("conv_id", "turn", "role", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("parent_turn"))


@query("SELECT event_type, (json_extract(props, '$.k')::BIGINT) % 10 AS k, count(*) AS n FROM events WHERE (json_extract(props, '$.k')::BIGINT) >= 5 GROUP BY ALL")
def json_props(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t("events").filter(k >= 5).groupBy("event_type", (k % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_type, count(*) AS n, epoch_us(min(ts)) AS first_ts FROM events GROUP BY ALL")
def provider_counts(t):
    return t("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.min("ts").cast("timestamp")).alias("first_ts"))


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 15 MINUTES, ts)) AS start, count(*) AS n FROM (SELECT DISTINCT ON (user_id, event_type, date_trunc('hour', ts)) * FROM events ORDER BY user_id, event_type, date_trunc('hour', ts), ts, event_id) GROUP BY ALL")
def quarter_hour_counts(t):
    """First sighting of each (user, type) an hour, counted by quarter-hour: the batch form of the streaming operators."""
    return _quarter_hour_counts(t("events"))


def _quarter_hour_counts(events: DataFrame) -> DataFrame:
    hour = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("hour", F.date_trunc("hour", "ts"))
    first = hour.groupBy("user_id", "event_type", "hour").agg(F.min(F.struct("ts", "event_id")).alias("f")).select("event_type", "f.ts")
    return first.groupBy("event_type", F.unix_micros(times.quarter_hour(F.col("ts"))).alias("start")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL 15 MINUTES, ts)) AS start, count(*) AS n FROM (SELECT event_type, min(ts) AS ts FROM events GROUP BY user_id, event_type, date_trunc('hour', ts)) GROUP BY ALL")
def quarter_hour_counts_whole(t):
    """The counts of quarter_hour_counts, with SQL by groups instead of first rows."""
    return _quarter_hour_counts(t("events"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_event_dedupe(t):
    """Events through the file stream with deduplication, read as far as there are files."""
    from tickerloom.streaming import ingest

    table = t("events")
    spark, folder = table.sparkSession, unquote(table.inputFiles()[0]).rsplit("/", 1)[0]
    base = spark.sparkContext.getCheckpointDir().rstrip("/") + f"/stream-{uuid.uuid4().hex}"
    files = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet" if folder.rsplit("/", 1)[-1] != "events.parquet" else "*.parquet").load(folder)
    ingest.write_batches(ingest.dedupe(files.select("user_id", "event_type"), ["user_id", "event_type"], "ts"), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("user_id", "event_type")


# --- ingest and editorial reads ------------------------------------------------------------------------------------------

_ITEMS = """
WITH it AS (SELECT o_orderkey AS cluster_id, ['basketball', 'football', 'golf'][(o_custkey % 3 + 1)::INT] AS sport, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 1000 END AS rank, o_totalprice AS score,
  'r' || (o_orderkey % 3) AS run_id, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'candidate' ELSE 'held' END AS status, CASE WHEN o_orderkey % 8 = 0 THEN 'ineligible' ELSE 'eligible' END AS eligibility, o_orderdate AS last_seen_at FROM orders)
"""


def _items(t) -> DataFrame:
    o = F.col("o_orderkey")
    return t("orders").select(
        o.alias("cluster_id"), F.element_at(F.array(F.lit("basketball"), F.lit("football"), F.lit("golf")), (F.col("o_custkey") % 3 + 1).cast("int")).alias("sport"), F.when(o % 6 != 0, o % 1000).alias("rank"),
        F.col("o_totalprice").alias("score"), F.concat(F.lit("r"), (o % 3).cast("string")).alias("run_id"), F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "candidate").otherwise("held").alias("status"),
        F.when(o % 8 == 0, "ineligible").otherwise("eligible").alias("eligibility"), F.col("o_orderdate").cast("timestamp").alias("last_seen_at"),
    )


@query(_ITEMS + "SELECT cluster_id, CASE WHEN run_id = 'r1' AND cluster_id % 50 <> 0 THEN rank END AS rank, CASE WHEN cluster_id % 50 = 0 THEN 'ineligible' ELSE eligibility END AS eligibility FROM it")
def finish_rank(t):
    items = _items(t)
    return editorial.finish_rank(items, F.lit("r1"), items.filter("cluster_id % 50 = 0").select("cluster_id")).select("cluster_id", "rank", "eligibility")


@query(_ITEMS + "SELECT cluster_id, rank, score, status FROM it WHERE sport = 'basketball' AND status IN ('approved', 'candidate') ORDER BY it.rank NULLS LAST, score DESC, cluster_id LIMIT 500")
def list_items(t):
    return editorial.list_items(_items(t), "basketball", ["approved", "candidate"], limit=500).select("cluster_id", "rank", "score", "status")


@query(
    _MEMBERS
    + """, g AS (SELECT cluster_id, count(DISTINCT source) AS source_count, max(fresh_at) AS last_seen_at, CASE WHEN count(*) FILTER (WHERE confidence = 'medium') > 0 THEN 'medium' ELSE 'high' END AS confidence FROM m GROUP BY cluster_id)
SELECT cluster_id, source_count, epoch_us(last_seen_at) AS last_seen_at FROM g WHERE confidence = 'high' AND source_count >= 4 ORDER BY source_count DESC, g.last_seen_at DESC, cluster_id LIMIT 200"""
)
def list_clusters(t):
    feed = clustering.cluster_aggregates(_profiled_members(t)).withColumn("sport", F.lit("golf"))
    return editorial.list_clusters(feed, min_confidence="high", min_sources=4, by_sources=True, limit=200).select("cluster_id", "source_count", _micros("last_seen_at"))


@query(_MEMBERS + "SELECT cluster_id, source AS domain, count(*) AS n, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, source) AS nth FROM m GROUP BY cluster_id, source")
def source_summary(t):
    s = editorial.source_summary(_members(t).withColumn("domain", F.col("source")))
    return s.select("cluster_id", "domain", "n", F.col("nth").cast("long").alias("nth"))


@query(
    _CAND
    + """, st AS (SELECT provider, source || lang AS fingerprint, count(*) AS n FROM cand WHERE candidate_id % 2 = 0 GROUP BY ALL),
f AS (SELECT provider, source || lang AS fingerprint, count(*) AS n FROM cand WHERE candidate_id % 2 = 1 GROUP BY ALL)
SELECT coalesce(st.provider, f.provider) AS provider, coalesce(st.fingerprint, f.fingerprint) AS fingerprint, coalesce(st.n, 0) + coalesce(f.n, 0) AS times_seen FROM st FULL JOIN f ON st.provider = f.provider AND st.fingerprint = f.fingerprint"""
)
def merge_rejections(t):
    c = _cand(t).select("candidate_id", "provider", F.concat("source", "lang").alias("fingerprint"), F.array("sport").alias("reasons"))
    stored = c.filter("candidate_id % 2 = 0").groupBy("provider", "fingerprint").agg(F.min("reasons").alias("reasons"), F.count(F.lit(1)).alias("times_seen"))
    return ingest_unit.merge_rejections(stored, c.filter("candidate_id % 2 = 1")).select("provider", "fingerprint", "times_seen")


@query(
    _PAGES
    + """, b AS (SELECT page_id AS candidate_id, normalized AS normalized_url, domain FROM norm WHERE normalized IS NOT NULL AND page_id % 3 <> 0), k AS (SELECT DISTINCT normalized FROM norm WHERE page_id % 3 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY normalized_url ORDER BY candidate_id) AS n FROM b) SELECT candidate_id, n = 1 AND normalized_url NOT IN (SELECT normalized FROM k WHERE normalized IS NOT NULL) AS inserted FROM o"""
)
def ingest_batch(t):
    p = _normalized_pages(t).filter("normalized is not null").select(
        F.col("page_id").alias("candidate_id"), F.col("normalized").alias("normalized_url"), F.lit(1).alias("provider"), F.lit(None).cast("string").alias("provider_item_id"), F.lit("").alias("normalized_headline")
    )
    return warehouse.ingest_batch(p.filter("candidate_id % 3 <> 0"), p.filter("candidate_id % 3 = 0")).select("candidate_id", "inserted")


@query()
def ingest_batch_items(t):
    """ingest_batch with item ids (a hash of the page's path), so that both keys interact; tests compare it with a loop."""
    path = F.regexp_extract("normalized", r"^[a-z]+://[^/]+(.*)$", 1)
    p = _normalized_pages(t).filter("normalized is not null").select(
        F.col("page_id").alias("candidate_id"), F.col("normalized").alias("normalized_url"), F.lit(1).alias("provider"),
        F.when(F.col("page_id") % 5 != 0, F.md5(path)).alias("provider_item_id"), F.md5(F.concat(F.lit("h"), F.col("page_id").cast("string"))).alias("normalized_headline"),
    )
    stored = p.filter("candidate_id % 3 = 0")
    return warehouse.ingest_batch(p.filter("candidate_id % 3 <> 0"), stored).select("candidate_id", "inserted")


from tickerloom.plans import decisions, editing  # noqa: E402, F401  they register their queries
