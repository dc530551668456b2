"""Candidate building and the intake filter with named reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions import classify, fixed, text, urls

REASONS = [
    "malformed-headline", "non-english", "betting-or-fantasy", "template-page", "video-page", "generic-page",
    "historical-stats-page", "not-sports", "low-quality-source",
]


def _any(column: Column, patterns: list[str]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | column.rlike(p)
    return hit


def reject_reasons(headline: Column, url: Column, language: Column, categories: Column, confidence: Column, quality: Column) -> Column:
    """All reasons for which an article is refused, in fixed order; empty if it is accepted."""
    h = F.coalesce(headline, F.lit(""))
    path = urls.path(url)
    english = language.isNull() | (F.trim(language) == "") | F.trim(language).rlike(r"(?i)^(en|eng|english)\b")
    no_sport = F.coalesce((F.size(categories) > 0) & ~F.exists(categories, lambda c: F.lower(c).isin("sport", "sports")), F.lit(False))
    tests = {
        "malformed-headline": (F.size(F.filter(F.split(h, r"\s+"), lambda w: w != "")) < 3)
        | (F.length(F.regexp_replace(h, r"[^\p{L}]", "")) < 12)
        | h.rlike(r"(?i)^https?://")
        | h.contains("�"),
        "non-english": ~english | h.rlike(fixed.SPANISH_CLIP),
        "betting-or-fantasy": _any(h, fixed.BETTING) | (h.rlike(fixed.BARE_ODDS) & ~h.rlike(fixed.ODDS_IDIOM)),
        "template-page": _any(h, fixed.TEMPLATE_PAGES),
        "video-page": _any(h, fixed.VIDEO_TITLES) | path.rlike(fixed.VIDEO_PATH),
        "generic-page": path.isin("/", ""),
        "historical-stats-page": h.rlike(fixed.HISTORICAL_STATS),
        "not-sports": no_sport & F.coalesce(confidence == "low", F.lit(False)),
        "low-quality-source": F.coalesce(quality == "low-quality", F.lit(False)),
    }
    return F.array_compact(F.array(*[F.when(tests[r], F.lit(r)) for r in REASONS]))


def build_candidates(raw: DataFrame) -> DataFrame:
    """Raw (provider, provider_item_id, headline, source_url, published_at, discovered_at, language, categories, query_sport) to candidates.

    Rows with a blank headline or an address that is no http(s) URL are left out; each step is a projection.
    """
    kept = raw.withColumn("headline", F.trim("headline")).filter(F.col("headline") != "")
    kept = kept.withColumn("normalized_url", urls.normalize_url(F.col("source_url"))).filter(F.col("normalized_url").isNotNull())
    kept = kept.withColumns(
        {
            "domain": urls.domain(F.col("source_url")),
            "fingerprint": urls.fingerprint(F.col("source_url")),
            "normalized_headline": text.normalize_headline(F.col("headline")),
        }
    ).withColumn("source_quality", urls.source_quality(F.col("domain")))
    return classify.classify(kept, "headline", "query_sport", "categories").drop("evidence")


def with_reasons(candidates: DataFrame) -> DataFrame:
    c = F.col
    return candidates.withColumn("reasons", reject_reasons(c("headline"), c("source_url"), c("language"), c("categories"), c("confidence"), c("source_quality")))


def split_intake(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); rejected rows keep all their reasons."""
    judged = with_reasons(candidates)
    return judged.filter(F.size("reasons") == 0).drop("reasons"), judged.filter(F.size("reasons") > 0)


def summary(candidates: DataFrame, rejected: DataFrame) -> DataFrame:
    """(kind, key, n): accepted by sport and by provider, rejected by reason."""
    count = lambda df, kind, key: df.groupBy(F.lit(kind).alias("kind"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    reasons = rejected.select(F.explode("reasons").alias("reason"))
    return count(candidates, "sport", "sport").unionByName(count(candidates, "provider", "provider")).unionByName(count(reasons, "reason", "reason"))
