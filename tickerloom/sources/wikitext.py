"""The sports section of a day's current-events page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strip_markup(text: Column) -> Column:
    """Plain text: no references, comments, templates, tags or quotes of emphasis; links by their label."""
    steps = [
        (r"(?s)<ref[^>/]*/>|<ref[^>]*>.*?</ref>", ""), (r"(?s)<!--.*?-->", ""), (r"\{\{[^{}]*\}\}", ""), (r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1"),
        (r"\[https?://[^\s\]]+(?:\s[^\]]*)?\]", ""), (r"<[^>]+>", ""), (r"'{2,}", ""), (r"&nbsp;", " "), (r"\s+", " "), (r"\s+([,.;:])", "$1"),
    ]
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return F.trim(text)


def parse_sports(pages: DataFrame) -> DataFrame:
    """(day, wikitext) to one row a link: (day, line, item, parent, url, publisher).

    The section runs from the bold Sports heading to the next bold heading, comment or template. A first-level bullet without
    links is the parent of deeper ones below it; parents are carried forward by a window over the page's lines.
    """
    lines = pages.select("day", F.posexplode(F.split("wikitext", "\n")).alias("line", "raw")).withColumn("raw", F.trim("raw"))
    so_far = Window.partitionBy("day").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.col("raw").rlike(r"^'''\s*Sports?\s*'''")
    edge = F.col("raw").rlike(r"^('''|<!--|\{\{)")
    marked = lines.withColumn("inside", F.last(F.when(heading, True).when(edge, False), ignorenulls=True).over(so_far))
    bullets = marked.filter(F.col("inside") & ~heading & F.col("raw").startswith("*")).withColumn("depth", F.length(F.regexp_extract("raw", r"^(\*+)", 1)))
    links = F.regexp_extract_all("raw", F.lit(r"\[(https?://[^\s\]]+\s[^\]]*)\]"), F.lit(1))
    bullets = bullets.withColumns({"links": links, "item": strip_markup(F.regexp_replace("raw", r"^\*+\s*", ""))})
    own = F.when(F.col("depth") == 1, F.when(F.size("links") == 0, F.col("item")).otherwise(F.lit("")))
    bullets = bullets.withColumn("parent", F.last(own, ignorenulls=True).over(so_far))
    rows = bullets.filter(F.size("links") > 0).withColumn("parent", F.when((F.col("depth") > 1) & (F.col("parent") != ""), F.col("parent")))
    exploded = rows.select("day", "line", "item", "parent", F.explode("links").alias("link"))
    return exploded.select("day", "line", "item", "parent", F.regexp_extract("link", r"^(\S+)", 1).alias("url"), F.regexp_replace(F.regexp_extract("link", r"^\S+\s+(.*)$", 1), r"^\(|\)$", "").alias("publisher"))


def candidates(items: DataFrame, discovered_at: Column) -> DataFrame:
    """One raw candidate a link; the sentence is discovery text, the parent event only helps to classify."""
    return items.select(
        F.lit("wikipedia").alias("provider"), F.lit(None).cast("string").alias("provider_item_id"), F.col("item").alias("headline"), F.col("url").alias("source_url"), F.to_timestamp("day").alias("published_at"),
        discovered_at.alias("discovered_at"), F.lit("en").alias("language"), F.lit(None).cast("array<string>").alias("categories"), F.lit(None).cast("string").alias("query_sport"), F.col("parent").alias("context"),
    )
