"""Line deduplication with DataFrame operations only.

Lines become (hash, document, position); no text is shuffled to find repeats. Hashes are range-partitioned and sorted by
document (largest first) and position, so that the first rows of a hash are the occurrence to keep. What comes back to the
documents are run-length coded keep bitmaps.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import materialize

_SPACE = " \t\n\x0b\x0c\r"
#: Hashes taken out of the range partitioning, being the most frequent: at most so many.
HOT_KEYS = 1000


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space around it, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def line_entries(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(doc_id, sig, pos, h1, h2) of each line with a key of ``min_chars`` code points or more; sig tells texts of one doc_id apart."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("sig"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line")).select(
        "doc_id", "sig", "pos", line_key(F.col("line")).alias("line")
    )
    return keyed.filter(F.char_length("line") >= min_chars).select("doc_id", "sig", "pos", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def dropped_lines(entries: DataFrame, min_docs: int = 3) -> DataFrame:
    """(doc_id, sig, pos) of lines whose hash occurs in ``min_docs`` documents or more, but for the largest doc_id's.

    The most frequent hashes (a sketch of bounded size names candidates; a miss or a surplus changes no result) are counted with map-side
    aggregation and joined back by broadcast, at most HOT_KEYS rows and their splits by h2. All others are range-partitioned.
    """
    top = entries.agg(F.expr(f"approx_top_k(h1, {HOT_KEYS}, {HOT_KEYS * 10})").alias("top"))
    hot = F.broadcast(top.select(F.explode("top").alias("t")).select(F.col("t.item").alias("h1")))

    of_hot = entries.join(hot, "h1")
    stats = of_hot.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("one").alias("n_docs"), F.max("doc_id").alias("keep"))
    stats = stats.filter(F.col("n_docs") >= min_docs).select("h1", "h2", "keep")
    from_hot = entries.join(F.broadcast(stats), ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keep"))).select("doc_id", "sig", "pos")

    in_key = Window.partitionBy("h1", "h2")
    ranged = entries.join(hot, "h1", "left_anti").repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", F.col("doc_id").desc(), "pos")
    streamed = ranged.withColumn("nth_doc", F.dense_rank().over(in_key.orderBy(F.col("doc_id").desc()))).withColumn("n_docs", F.max("nth_doc").over(in_key))
    from_range = streamed.filter((F.col("n_docs") >= min_docs) & (F.col("nth_doc") > 1)).select("doc_id", "sig", "pos")
    return from_hot.unionByName(from_range)


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """(doc_id, sig, gaps): a document's dropped lines as ascending runs (first, after); the complement is its keep bitmap, run-length coded."""
    in_doc = Window.partitionBy("doc_id", "sig").orderBy("pos")
    runs = dropped.withColumn("run", F.col("pos") - F.dense_rank().over(in_doc)).groupBy("doc_id", "sig", "run").agg(F.min("pos").alias("first"), (F.max("pos") + 1).alias("after"))
    return runs.groupBy("doc_id", "sig").agg(F.array_sort(F.collect_list(F.struct("first", "after"))).alias("gaps"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop lines repeated across documents; returns every column of ``docs`` with ``text`` replaced, plus n_lines and n_dropped.

    A line goes if its key (white space around it cut, A-Z lower-cased) has ``min_chars`` code points or more and occurs in
    ``min_docs`` documents or more, unless its document has the largest doc_id among them. Other lines are joined by newlines.
    Null or empty text: one empty line, text becomes "". Null doc_id: one document, smaller than any other. Rows of one
    doc_id count as one document and keep their lines alike. Empty table: no rows. Columns of ``docs`` named n_lines or
    n_dropped are replaced; other names do not clash.
    """
    # Lines are hashed once; the sketch, the statistics and the range partitioning read them from here.
    entries = materialize(line_entries(docs, min_chars), "lines")
    bitmaps = keep_bitmaps(dropped_lines(entries, min_docs)).select(F.col("doc_id").alias("__id"), F.col("sig").alias("__sig"), F.col("gaps").alias("__gaps"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    joined = docs.select(*names).join(bitmaps, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__sig")), "left")
    lines = joined.withColumn("__lines", split_lines(F.col("text")))
    starts = F.concat(F.array(F.lit(0)), F.col("__gaps.after"))
    ends = F.concat(F.col("__gaps.first"), F.array(F.size("__lines")))
    kept = F.flatten(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda r: F.slice("__lines", r["a"] + 1, r["b"] - r["a"])))
    text = F.when(F.col("__gaps").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    dropped = F.coalesce(F.aggregate("__gaps", F.lit(0), lambda n, g: n + g["after"] - g["first"]), F.lit(0))
    return lines.select(
        *[text.alias(c) if c == "text" else F.col(c) for c in names],
        F.size("__lines").cast("long").alias("n_lines"),
        dropped.cast("long").alias("n_dropped"),
    )


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), often AS (
  SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, o.key IS NOT NULL AND k.doc_id <> o.keep AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
