"""Article lists in JSON: two layouts, one shape of raw candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARTLIST = "articles array<struct<url: string, title: string, seendate: string, socialimage: string, domain: string, language: string>>"
NEWSDATA = "results array<struct<article_id: string, title: string, link: string, description: string, pubDate: string, image_url: string, source_id: string, source_name: string, language: string, category: array<string>>>"


def _raw(provider: str, item: Column, headline: Column, url: Column, at: Column, discovered: Column, language: Column, categories: Column, sport: Column) -> list[Column]:
    names = ["provider", "provider_item_id", "headline", "source_url", "published_at", "discovered_at", "language", "categories", "query_sport"]
    return [c.alias(n) for c, n in zip([F.lit(provider), item, headline, url, at, discovered, language, categories, sport], names)]


def artlist(responses: DataFrame, discovered_at: Column, query_sport: Column) -> DataFrame:
    """Responses (body) of the article-list layout; a body without ``articles`` gives no rows."""
    rows = responses.select("*", F.explode(F.from_json("body", ARTLIST)["articles"]).alias("a"))
    at = F.try_to_timestamp(F.col("a.seendate"), F.lit("yyyyMMdd'T'HHmmss'Z'"))
    none = F.lit(None).cast("string")
    return rows.select(*_raw("artlist", none, F.col("a.title"), F.col("a.url"), at, discovered_at, F.col("a.language"), F.lit(None).cast("array<string>"), query_sport))


def newsdata(responses: DataFrame, discovered_at: Column, query_sport: Column) -> DataFrame:
    """Responses (body) of the result-list layout, with item ids and categories."""
    rows = responses.select("*", F.explode(F.from_json("body", NEWSDATA)["results"]).alias("a"))
    at = F.try_to_timestamp(F.col("a.pubDate"), F.lit("yyyy-MM-dd HH:mm:ss"))
    return rows.select(*_raw("newsdata", F.col("a.article_id"), F.col("a.title"), F.col("a.link"), at, discovered_at, F.col("a.language"), F.col("a.category"), query_sport))


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """One row a stored response file."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "body")


def response_state(status: Column, body: Column) -> Column:
    """ok, throttled or error for a stored response: 429 or a plain-text body means throttled, other non-JSON an error."""
    json_like = F.trim(body).rlike(r"^[\[{]")
    return F.when((status == 429) | (~json_like & body.rlike("(?i)limit requests|too many")), "throttled").when((status >= 400) | ~json_like, "error").otherwise("ok")


def query_terms(terms: list[str], english: bool = False) -> str:
    """Terms joined by OR, those of several words quoted."""
    joined = " OR ".join(f'"{t}"' if " " in t else t for t in terms)
    return f"({joined}) sourcelang:english" if english else joined
