"""Source divergence audit: how far the terms of each source of a language lie from those of its other sources.

Terms are dealt into tiles. In a tile, terms that many groups hold are a dense matrix of groups by terms; the others are
postings that correct a sum in which every group lacks every term. Both partial sums are integers and are added as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import discard, doc_batches, materialize

#: Documents of a language that a term must be in, and terms listed for each group.
LEAST_DOCUMENTS, MOST_TERMS = 3, 200
ONE = 1_000_000_000
#: Groups that hold a light term at most; terms of a tile, and cells (groups by terms) of one, at most; groups of one block of pairs.
LIGHT, TILE_TERMS, TILE_CELLS, PAIR_GROUPS = 4, 4096, 1 << 20, 256
#: Distinct (group, term) entries that a task holds before it passes them on, and bytes of text that it splits at once.
HELD, CHUNK = 300_000, 1 << 20

_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def term_counts_of(text: bytes) -> dict[bytes, int]:
    """Occurrences of each term of a text; a long text is split by pieces that end between terms."""
    found: dict[bytes, int] = {}
    at = 0
    while at < len(text):
        end = min(at + CHUNK, len(text))
        while end < len(text) and _TERM.match(text, end, end + 1):
            run = _TERM.match(text, end)
            end = run.end()
        for t in _TERM.findall(text[at:end].translate(_LOWER)):
            found[t] = found.get(t, 0) + 1
        at = end
    return found


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term of each group; the empty term counts the group's rows.

    Tasks add up what they read before it is shuffled, so a term or source that is everywhere is a row a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[int]] = {}

        def flush() -> pa.RecordBatch:
            keys, sums = list(held), list(held.values())
            columns = [pa.array([k[i] for k in keys], pa.string()) for i in (0, 1)]
            columns += [pa.array([k[2] for k in keys], pa.binary()).cast(pa.string()), pa.array([s[0] for s in sums], pa.int64()), pa.array([s[1] for s in sums], pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

        for batch, texts in doc_batches(batches):
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
                for term, n in [(b"", 0), *term_counts_of(text).items()]:
                    s = held.setdefault((lang, source, term), [0, 0])
                    s[0] += n
                    s[1] += 1
                if len(held) >= HELD:
                    yield flush()
        if held:
            yield flush()

    group = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    counted = docs.select(*group, "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column) -> Column:
    """1 + floor(10**9 * (n + 1) / total) in longs: a long division by thousands, as the product may not fit. 1 without terms."""
    rest, out = n + 1, F.lit(0).cast("long")
    whole = lambda a: F.call_function("div", a, total)
    out, rest = whole(rest), rest % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + whole(rest), rest % total
    return F.when(total > 0, out + 1).otherwise(F.lit(1).cast("long"))


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / q); shares are at most 10**9 + 1, so the square is a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def tile_sums(base: np.ndarray, of: np.ndarray, term: np.ndarray, p: np.ndarray, n_terms: int, rows: slice) -> np.ndarray:
    """Sums over a tile's n_terms terms of floor((p_g - p_h)**2 / p_h) for the groups g of ``rows`` against all groups h.

    base: a group's share of a term that it lacks. of, term, p: the postings' groups, terms and shares, groups and terms from 0.
    """
    g_base, groups = base[rows], len(base)
    held_by = np.bincount(term, minlength=n_terms)
    heavy = np.flatnonzero(held_by > LIGHT)
    total = (n_terms - len(heavy)) * _distances(g_base[:, None], base[None, :])

    # Heavy terms: a dense tile of groups by terms.
    if len(heavy):
        place = np.full(n_terms, -1)
        place[heavy] = np.arange(len(heavy))
        dense = np.repeat(base[:, None], len(heavy), 1)
        mine = place[term] >= 0
        dense[of[mine], place[term[mine]]] = p[mine]
        for i, row in enumerate(dense[rows]):
            total[i] += _distances(row[None, :], dense).sum(1)

    # Light terms: each posting against groups that lack the term, equal postings at once ...
    light = np.flatnonzero(held_by[term] <= LIGHT)
    if len(light):
        (g, v), times = np.unique(np.stack([of[light], p[light]]), axis=1, return_counts=True)
        mine = (g >= rows.start) & (g < rows.start + len(g_base))
        for at, value, count in zip(g[mine] - rows.start, v[mine], times[mine]):
            total[at] += count * (_distances(value, base) - _distances(g_base[at], base))
        for start in range(0, len(g), 4096):
            h, value, count = g[start : start + 4096], v[start : start + 4096], times[start : start + 4096]
            change = count * (_distances(g_base[:, None], value[None, :]) - _distances(g_base[:, None], base[h][None, :]))
            np.add.at(total.T, h, change.T)
        # ... then the pairs of groups that both hold it: at most LIGHT - 1 others for each posting.
        order = light[np.argsort(term[light], kind="stable")]
        for step in range(1, LIGHT):
            both = np.flatnonzero(term[order[step:]] == term[order[:-step]])
            for a, b in ((order[both], order[both + step]), (order[both + step], order[both])):
                mine = (of[a] >= rows.start) & (of[a] < rows.start + len(g_base))
                ga, gb, pa_, pb = of[a[mine]], of[b[mine]], p[a[mine]], p[b[mine]]
                change = _distances(pa_, pb) - _distances(pa_, base[gb]) - _distances(base[ga], pb) + _distances(base[ga], base[gb])
                np.add.at(total, (ga - rows.start, gb), change)
    return total


def pair_sums(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of a language's groups.

    postings: lang, term, source, p of the kept terms that a group holds. groups: lang, source, base, v (kept terms of the
    language), g (groups of it). A task gets a tile of terms with its postings and one row a group, for a block of groups on
    the left; no pairs of rows leave it, only sums.
    """
    tile_terms = F.greatest(F.lit(1), F.least(F.lit(TILE_TERMS), F.floor(F.lit(TILE_CELLS) / F.col("g"))))
    tiles = F.greatest(F.lit(1), F.ceil(F.col("v") / tile_terms)).cast("int").alias("tiles")
    blocks = F.ceil(F.col("g") / PAIR_GROUPS).cast("int").alias("blocks")
    langs = groups.groupBy("lang").agg(F.max("v").alias("v"), F.max("g").alias("g")).select("lang", tiles, blocks)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    dealt = postings.join(langs, "lang").withColumn("tile", F.pmod(F.xxhash64("term"), F.col("tiles")).cast("int")).select("lang", "tile", every("blocks", "block"), "term", "source", "p")
    bases = groups.select("lang", "source", "base").join(langs, "lang").select("lang", "source", "base", "blocks", every("tiles", "tile")).select("lang", "tile", every("blocks", "block"), "source", "base")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        lang, _, block = key
        names = np.sort(right["source"].to_numpy(object))
        at = {s: i for i, s in enumerate(names)}
        base = np.ones(len(names), np.int64)
        base[[at[s] for s in right["source"]]] = right["base"]
        codes, terms = pd.factorize(left["term"])
        of = np.array([at[s] for s in left["source"]], np.int64)
        rows = slice(block * PAIR_GROUPS, (block + 1) * PAIR_GROUPS)
        total = tile_sums(base, of, codes, left["p"].to_numpy(np.int64), len(terms), rows)
        g, h = np.nonzero(np.arange(len(names))[rows][:, None] != np.arange(len(names))[None, :])
        return pd.DataFrame({"lang": lang, "source": names[rows][g], "item": names[h], "value": total[g, h]})

    cells = ["lang", "tile", "block"]
    sums = dealt.groupBy(*cells).cogroup(bases.groupBy(*cells)).applyInPandas(run, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: a group's distance from each other source of its language, and its own terms.

    Terms are runs of letters and of characters beyond ASCII, A-Z in lower case; each language keeps those in at least
    ``least_documents`` of its rows, V in number. A group (or language) with count occurrences of a kept term, N in all, has the
    share p = 1 + floor(10**9 * (count + 1) / (N + V)). Part ``pair``: the sum over kept terms of floor((p - q)**2 / q) with the
    other source's q. Part ``term``: kept terms that the group holds with p over the language's q, by the same measure, up to
    ``most_terms``. Ranks go by value, then by the item's UTF-8. All numbers are integers; a pair's sum stays within a long while
    V < 2 * 10**9.

    Null text, lang or source count as ''. A group without terms has base shares; a language without kept terms gives pairs of
    value 0; a language with one source gives no pairs. Every row is a document, repeated rows and doc_ids too. Long texts are split by
    pieces. A source that holds a third of all rows is combined before the shuffle. Empty table: no rows. Other columns are left out.
    """
    counts = materialize(term_counts(docs.select("lang", "source", "text")), "terms")
    named = counts.filter("term <> ''")
    kept = materialize(named.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("d")).filter(F.col("d") >= least_documents).select("lang", "term", "n_lang"), "kept-terms")
    held = materialize(named.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "n_lang"), "held")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("n_total"))
    sources = counts.filter("term = ''").select("lang", "source")
    g = sources.groupBy("lang").agg(F.count(F.lit(1)).alias("g"))
    groups = sources.join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left").join(g, "lang")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    groups = groups.select("lang", "source", "g", zero("v").alias("v"), (zero("n_group") + zero("v")).alias("total"), (zero("n_total") + zero("v")).alias("total_lang"))
    groups = materialize(groups.withColumn("base", share(F.lit(0).cast("long"), F.col("total"))), "groups")

    shares = held.join(groups, ["lang", "source"]).select("lang", "source", "term", share(F.col("n"), F.col("total")).alias("p"), share(F.col("n_lang"), F.col("total_lang")).alias("q"))
    pairs = pair_sums(shares.select("lang", "term", "source", "p"), groups.select("lang", "source", "base", "v", "g"))
    own = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    own = own.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= most_terms)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value))
    found = materialize(pairs.unionByName(own), "audit")
    discard(counts, kept, held, groups)
    return found


def oracle(least_documents: int = LEAST_DOCUMENTS, most_terms: int = MOST_TERMS) -> str:
    return rf"""
    WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    occurrences AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
    kept AS (SELECT lang, term, count(*) AS n FROM occurrences GROUP BY lang, term HAVING count(DISTINCT row) >= {least_documents}),
    groups AS (SELECT DISTINCT lang, source FROM docs),
    held AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM occurrences o JOIN kept USING (lang, term) GROUP BY ALL),
    per_lang AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
    per_group AS (SELECT g.lang, g.source, coalesce(sum(h.n), 0)::HUGEINT AS total FROM groups g LEFT JOIN held h USING (lang, source) GROUP BY ALL),
    shares AS (SELECT p.lang, p.source, k.term, coalesce(h.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(h.n, 0) + 1)) // (p.total + l.v) AS p,
           1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v) AS q
      FROM per_group p JOIN per_lang l USING (lang) JOIN kept k ON k.lang = p.lang LEFT JOIN held h ON h.lang = p.lang AND h.source = p.source AND h.term = k.term),
    summed AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
      FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
      FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM (FROM pairs UNION ALL FROM terms))
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {most_terms}"""
