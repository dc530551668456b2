"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import doc_batches, materialize, mix, word_hashes

#: Words of the window that decides, and the share of them that must be equal.
WINDOW, SHARE_PERCENT, LEAST_WORDS = 20, 80, 5
#: Masks: 1 is compared, 0 ignored. Wherever the unequal words of a window of WINDOW words stand, the mask for long items fits somewhere
#: in between; for items under WINDOW words one of the two short ones does. A test goes through all cases.
MASKS = ("1101001",)
SHORT_MASKS = ("1101", "1011")
#: Benchmarks of at most so many words are sent to every worker (about 24 bytes a word); larger ones are joined by shuffle.
BROADCAST_WORDS = 2_000_000

#: Tasks that rows of one seed are dealt to, where seeds are joined by shuffle.
SALTS = 8

#: Bits of the filter of items' seeds that every worker holds where seeds are joined by shuffle: 16 MB, whatever the benchmark's size.
FILTER_BITS = 27

_HITS = "doc_id long, item_id long, n_match long, window long, doc_start long, item_start long"


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at each position of a sequence of word hashes."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, int(mask, 2), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n])
    return h


def masks_of(n_words: int) -> tuple[str, ...]:
    return MASKS if n_words >= WINDOW else SHORT_MASKS


def best_window(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(equal words, window, start in the item) of the best window when item word i stands at document word i + shift."""
    window = min(WINDOW, len(item))
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    equal = np.zeros(len(item) + 1, np.int64)
    equal[lo + 1 : hi + 1] = doc[lo + shift : hi + shift] == item[lo:hi]
    upto = np.cumsum(equal)
    in_window = upto[window:] - upto[:-window]
    at = int(in_window.argmax())
    return int(in_window[at]), window, at


def overlaps(n_match: int, window: int) -> bool:
    return 100 * n_match >= SHARE_PERCENT * window


def best_hits(doc: np.ndarray, candidates: dict[int, set[int]], items: dict[int, np.ndarray]) -> list[tuple[int, int, int, int, int]]:
    """(item, equal words, window, document start, item start) of each candidate item's best window that overlaps; ties to the earliest."""
    out = []
    for item_id, shifts in sorted(candidates.items()):
        found = max((best_window(doc, items[item_id], s) + (s,) for s in sorted(shifts)), key=lambda b: (b[0], -b[3]))
        if overlaps(found[0], found[1]):
            out.append((item_id, found[0], found[1], found[2] + found[3], found[2]))
    return out


@dataclass
class SeedTable:
    """A benchmark's words, and its seeds by mask: sorted hashes with item and position, and a filter on their top bits."""

    items: dict[int, np.ndarray]
    tables: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def of(rows: list[tuple[int, bytes]]) -> SeedTable:
        items = {i: w for i, t in rows if len(w := word_hashes(t)) >= LEAST_WORDS}
        tables = {}
        for mask in MASKS + SHORT_MASKS:
            own = [(i, seeds(w, mask)) for i, w in items.items() if mask in masks_of(len(w))]
            if not own:
                continue
            h = np.concatenate([s for _, s in own])
            of_item = np.concatenate([np.full(len(s), i, np.int64) for i, s in own])
            at = np.concatenate([np.arange(len(s)) for _, s in own])
            order = np.argsort(h, kind="stable")
            top = np.zeros(1 << 20, bool)
            top[h >> np.uint64(44)] = True
            tables[mask] = (h[order], of_item[order], at[order], top)
        return SeedTable(items, tables)

    def candidates(self, doc: np.ndarray) -> dict[int, set[int]]:
        """Items that share a seed with the document, and the shifts at which they do."""
        out: dict[int, set[int]] = {}
        for mask, (hashes, of_item, at, top) in self.tables.items():
            h = seeds(doc, mask)
            maybe = np.flatnonzero(top[h >> np.uint64(44)])
            first, last = np.searchsorted(hashes, h[maybe], "left"), np.searchsorted(hashes, h[maybe], "right")
            for p, a, b in zip(maybe[last > first], first[last > first], last[last > first]):
                for item_id, q in zip(of_item[a:b].tolist(), at[a:b].tolist()):
                    out.setdefault(item_id, set()).add(int(p) - q)
        return out


def _by_broadcast(docs: DataFrame, rows: list[tuple[int, bytes]]) -> DataFrame:
    table = docs.sparkSession.sparkContext.broadcast(SeedTable.of(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in doc_batches(batches):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
                words = word_hashes(text)
                out += [(doc_id, *hit) for hit in best_hits(words, table.value.candidates(words), table.value.items)]
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in _HITS.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, _HITS)


def seed_filter(item_seeds: DataFrame) -> np.ndarray:
    """A bitmap by the top FILTER_BITS bits of h: at most 2 ** (FILTER_BITS - 6) words reach the driver. Other seeds pass by chance, none of the items' is lost."""
    top = item_seeds.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).alias("top"))
    words = top.groupBy(F.shiftrightunsigned("top", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(top & 63 AS int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def passing(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Positions of the hashes that the bitmap lets through."""
    top = h >> np.uint64(64 - FILTER_BITS)
    return np.flatnonzero((bitmap[top >> np.uint64(6)] >> (top & np.uint64(63))) & np.uint64(1))


def _seed_rows(table: DataFrame, key: str, known: Broadcast | None = None) -> DataFrame:
    """(key, h, at) of seeds: without ``known`` an item's, only where it is long enough and by its own masks; with it a document's that pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in doc_batches(batches):
            for row_id, text in zip(batch.column("row").to_pylist(), texts):
                words = word_hashes(text)
                if known is None and len(words) < LEAST_WORDS:
                    continue
                for mask in masks_of(len(words)) if known is None else MASKS + SHORT_MASKS:
                    h = seeds(words, mask)
                    at = np.arange(len(h)) if known is None else passing(h, known.value)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array([row_id] * len(at), pa.string()), pa.array(h[at].view(np.int64)), pa.array(at, pa.int64())], [key, "h", "at"])

    return table.select("row", "text").mapInArrow(run, f"{key} string, h long, at long")


def _by_shuffle(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The same without a table on every worker: seeds of both sides are joined, and each pair of texts that they name is brought together once.

    Documents' seeds that no item has are dropped before the shuffle, but for those that a bitmap of fixed size lets through by chance. Equal texts are searched once; rows of a frequent seed are dealt to SALTS tasks, to each of which all items with it go.
    """
    keyed = docs.select("doc_id", "text", F.md5("text").alias("row")).filter(F.col("text").isNotNull())
    left = keyed.select("row", "text").dropDuplicates(["row"])
    right = benchmark.select("item_id", "text", F.col("item_id").cast("string").alias("row"))
    item_seeds = materialize(_seed_rows(right, "item"), "item_seeds")
    known = docs.sparkSession.sparkContext.broadcast(seed_filter(item_seeds))
    salted = _seed_rows(left, "doc", known).withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    spread = item_seeds.withColumnRenamed("at", "q").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = salted.join(spread, ["h", "salt"]).groupBy("doc", "item").agg(F.collect_set(F.col("at") - F.col("q")).alias("shifts"))
    pairs = materialize(pairs, "seeds")
    joined = pairs.join(left.select(F.col("row").alias("doc"), F.col("text").alias("doc_text")), "doc").join(right.select(F.col("row").alias("item"), "item_id", F.col("text").alias("item_text")), "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in doc_batches(batches, "doc_text"):
            out, items = [], batch.column("item_text").to_pylist()
            for doc, item_id, shifts, text, item in zip(batch.column("doc").to_pylist(), batch.column("item_id").to_pylist(), batch.column("shifts").to_pylist(), texts, items):
                hits = best_hits(word_hashes(text), {item_id: set(shifts)}, {item_id: word_hashes(item.encode())})
                out += [(doc, *hit) for hit in hits]
            columns = list(zip(*out)) or [()] * 6
            arrays = [pa.array(c, pa.int64() if k else pa.string()) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, ["row", *(f.split()[0] for f in _HITS.split(", ")[1:])])

    hits = joined.select("doc", "item_id", "shifts", "doc_text", "item_text").mapInArrow(run, _HITS.replace("doc_id long", "row string"))
    return keyed.select("doc_id", "row").join(hits, "row").select(*(f.split()[0] for f in _HITS.split(", ")))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """doc_id, item_id, n_match, window, doc_start, item_start (in words) for each document and benchmark item that overlap.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. They overlap if, at some shift, SHARE_PERCENT of WINDOW consecutive
    item words (all of a shorter item's) equal the document's; the row has the shift with the most, then the smallest.
    Substituted words therefore cost a place each, not the match. Items under LEAST_WORDS words take no part, nor do null texts or
    items without an item_id; of several texts of one item_id the smallest counts. Rows of a null doc_id and repeated rows of documents
    give a row each. Ties go to the smallest shift, then the earliest window. Very long texts: whole; time grows with their seeds that
    items have. Either table empty: no rows. Other columns are ignored. The size of the benchmark decides the way, never the rows.
    """
    named = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).groupBy("item_id").agg(F.min("text").alias("text"))
    size = named.agg(F.coalesce(F.sum(F.length("text") - F.length(F.regexp_replace("text", r"\s", ""))), F.lit(0)), F.count(F.lit(1))).first()
    if size[0] + size[1] > broadcast_words:
        return _by_shuffle(docs, named)
    return _by_broadcast(docs, [(r["item_id"], r["text"].encode()) for r in named.collect()])


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id has no overlap with the benchmark; null doc_ids stay."""
    bad = materialize(contaminated_pairs(docs, benchmark).select(F.col("doc_id").alias("__bad")).distinct(), "contaminated")
    return docs.join(bad, F.col("doc_id") == F.col("__bad"), "left_anti")


SQL = r"""
WITH item AS (
  SELECT item_id, regexp_split_to_array(regexp_replace(w, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+') AS ws
  FROM (SELECT item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM benchmark WHERE item_id IS NOT NULL)
), doc AS (
  SELECT doc_id, regexp_split_to_array(regexp_replace(w, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+') AS ws
  FROM (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents)
), item_word AS (
  SELECT item_id, len(ws) AS n, least(20, len(ws)) AS win, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS q FROM item WHERE len(ws) >= 5
), doc_word AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS p FROM doc
), enough AS (
  SELECT i.item_id, d.doc_id, d.p - i.q AS shift FROM doc_word d JOIN item_word i ON d.word = i.word
  GROUP BY ALL HAVING 100 * count(*) >= 80 * any_value(i.win)
), near AS (
  SELECT e.doc_id, e.item_id, e.shift, i.q, i.n, i.win FROM enough e JOIN item_word i ON i.item_id = e.item_id
  JOIN doc_word d ON d.doc_id = e.doc_id AND d.p = i.q + e.shift AND d.word = i.word
), counted AS (
  SELECT doc_id, item_id, shift, n, win, least(q, n - win) AS a FROM near
), windows AS (
  SELECT c.doc_id, c.item_id, c.shift, c.win, c.a, count(*) AS n_match
  FROM (SELECT DISTINCT * FROM counted) c JOIN near m ON m.doc_id = c.doc_id AND m.item_id = c.item_id AND m.shift = c.shift AND m.q >= c.a AND m.q < c.a + c.win
  GROUP BY ALL
), best AS (
  SELECT doc_id, item_id, max(n_match) AS n_match, any_value(win) AS "window" FROM windows GROUP BY ALL
)
SELECT doc_id, item_id, n_match, "window" FROM best WHERE 100 * n_match >= 80 * "window"
"""
