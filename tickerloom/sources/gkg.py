"""Tab-separated article metadata, one file a quarter of an hour."""

from __future__ import annotations

import html
import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.functions import text, times
from tickerloom.operators import intake

#: Columns of the format that are used, from 0; rows with fewer than LEAST_COLUMNS are no articles.
DATE, DOMAIN, URL, TRANSLATION, EXTRAS, LEAST_COLUMNS = 1, 3, 4, 25, 26, 27


@F.pandas_udf(T.StringType())
def decode_numeric_entities(s: pd.Series) -> pd.Series:
    """&#233; and &#xE9; by code; Spark has no built-in for code points beyond one byte."""
    known = re.compile(r"&#(?:[xX][0-9A-Fa-f]{1,6}|\d{1,7});")
    return s.map(lambda t: None if t is None else known.sub(lambda m: html.unescape(m[0]), t))


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines of the format to (stamp, reported_at, domain, url, translated, title); rows without a page title are left out."""
    cells = lines.select(F.split(column, "\t", -1).alias("c")).filter(F.size("c") >= LEAST_COLUMNS)
    cell = lambda n: F.trim(F.get("c", F.lit(n)))
    title = F.regexp_extract(F.get("c", F.lit(EXTRAS)), r"(?s)<PAGE_TITLE>(.*?)</PAGE_TITLE>", 1)
    rows = cells.select(
        cell(DATE).alias("stamp"), times.parse_stamp(cell(DATE)).alias("reported_at"), cell(DOMAIN).alias("domain"), cell(URL).alias("url"), (cell(TRANSLATION) != "").alias("translated"), title.alias("title")
    ).filter(F.col("title") != "")
    return rows.withColumn("title", F.trim(text.decode_entities(decode_numeric_entities("title"))))


def candidates(rows: DataFrame, discovered_at: Column) -> DataFrame:
    """Untranslated rows as classified candidates without a query sport; rows that show no sport are left out."""
    raw = rows.filter(~F.col("translated")).select(
        F.lit("gkg").alias("provider"), F.lit(None).cast("string").alias("provider_item_id"), text.strip_site_suffix(F.col("title")).alias("headline"), F.col("url").alias("source_url"),
        F.col("reported_at").alias("published_at"), discovered_at.alias("discovered_at"), F.lit("en").alias("language"), F.lit(None).cast("array<string>").alias("categories"), F.lit(None).cast("string").alias("query_sport"),
    )
    return intake.build_candidates(raw).filter(F.col("sport") != "unknown")


@F.pandas_udf(T.StringType())
def _first_entry(content: pd.Series) -> pd.Series:
    def read(raw: bytes) -> str | None:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            names = z.namelist()
            return z.read(names[0]).decode("utf-8", "replace") if names else None

    return content.map(read)


def read_zipped(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the first entry of each zip archive below ``path``, with its unit key; archives are small files of fixed cadence."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.zip$", 1).alias("unit_key"), F.explode(F.split(_first_entry("content"), "\n")).alias("value"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of unpacked files, with their unit key."""
    return spark.read.text(path).withColumn("unit_key", F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[A-Za-z]+)*$", 1))


def per_sport(found: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` candidates of each sport."""
    from tickerloom.operators.warehouse import first_n

    return first_n(found, "sport", limit, F.col("published_at").desc_nulls_last(), F.col("fingerprint")).drop("nth")
