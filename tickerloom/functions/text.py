"""Headline text as columns: normal forms, tokens, trigrams, numbers."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.functions import fixed


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition; Spark has no built-in for it."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def strip_diacritics(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without the combining marks U+0300 to U+036F."""
    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not "̀" <= c <= "ͯ"))


#: Letters of alphabets with capitals whose compatibility decomposition, without marks, differs from them.
_PLAIN = {
    c: p
    for low, high in ((0xC0, 0x24F), (0x370, 0x52F), (0x1E00, 0x1FFF), (0x2C60, 0x2C7F), (0xFB00, 0xFB06), (0xFF21, 0xFF5A))
    for c in map(chr, range(low, high + 1))
    if c.isalpha() and (p := "".join(d for d in unicodedata.normalize("NFKD", c) if not "\u0300" <= d <= "\u036f")) != c and p.strip() == p
}


def plain_letters(s: Column) -> Column:
    """strip_diacritics inside the JVM, for letters of the Latin, Greek and Cyrillic blocks and full-width ones; others lose only separate marks."""
    single = {c: p for c, p in _PLAIN.items() if len(p) == 1}
    several = {c: p for c, p in _PLAIN.items() if len(p) != 1}
    spelled = s
    for c, p in several.items():
        spelled = F.replace(spelled, F.lit(c), F.lit(p))
    t = F.when(s.rlike("[" + "".join(several) + "]"), spelled).otherwise(s)
    plain = F.regexp_replace(F.translate(t, "".join(single), "".join(single.values())), "[\u0300-\u036f]", "")
    return F.when(s.rlike(r"[^\x00-\x7F]"), plain).otherwise(s)  # most texts have nothing to translate


def normalize_headline(headline: Column, unicode_form: bool = True) -> Column:
    """The exact-duplicate key: compatibility form, no zero-width characters, plain quotes, dashes and dots, lower case, single blanks.

    ``unicode_form=False`` leaves out the compatibility form (the only step outside the JVM) for text known to be composed.
    """
    t = nfkc(headline) if unicode_form else headline
    t = F.regexp_replace(t, "[​-‍⁠﻿]", "")
    t = F.translate(t, "‘’‚‛′“”„‟″", "'''''" + '"""""')
    t = F.regexp_replace(t, "[‐-―−]", "-")
    t = F.replace(t, F.lit("…"), F.lit("..."))
    return F.trim(F.regexp_replace(F.lower(t), r"(?U)\s+", " "))


def strip_source_suffix(headline: Column) -> Column:
    """Drop a closing " – Publisher" of 2 to 60 characters."""
    return F.trim(F.regexp_replace(headline, fixed.SOURCE_SUFFIX, ""))


def _words(t: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(t), r"\s+"), lambda w: w != ""))


def strip_site_suffix(title: Column) -> Column:
    """Drop a site name: after the last " | " if three words stay, or after the last dash if it looks like a publisher's name."""
    pipe_head = F.trim(F.regexp_extract(title, r"^(?s)(.+) \| ", 1))
    dash_head = F.trim(F.regexp_extract(title, r"^(?s)(.+) [–—-] ", 1))
    dash_tail = F.trim(F.regexp_extract(title, r"^(?s).+ [–—-] (.*)$", 1))
    by_dash = (dash_head != "") & (_words(dash_head) >= 3) & (_words(dash_tail) <= 6) & dash_tail.rlike(fixed.PUBLISHER_WORDS)
    return F.when((pipe_head != "") & (_words(pipe_head) >= 3), pipe_head).when(by_dash, dash_head).otherwise(title)


def content_tokens(headline: Column, ascii_only: bool = False) -> Column:
    """Content words: no suffix, marks, possessives or stopwords; spelled-out numbers as digits. ``ascii_only`` skips the marks step."""
    t = strip_source_suffix(headline)
    t = F.lower(t if ascii_only else strip_diacritics(t))
    t = F.regexp_replace(F.regexp_replace(t, r"[’']s\b", ""), "[’']", "")
    numbers = F.create_map(*[F.lit(x) for pair in fixed.NUMBER_WORDS.items() for x in pair])
    tokens = F.transform(F.filter(F.split(t, "[^a-z0-9]+"), lambda w: w != ""), lambda w: F.coalesce(numbers[w], w))
    return F.filter(tokens, lambda w: ((F.length(w) > 1) | w.rlike(r"^\d$")) & ~w.isin(fixed.STOPWORDS))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 for two empty arrays."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of lower-cased alphanumeric words, each padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def gram_codes(grams: Column) -> Column:
    """Trigrams as numbers, one for each: three code points of 21 bits."""
    point = lambda g, i: F.ascii(F.substr(g, F.lit(i), F.lit(1))).cast("long")
    return F.transform(grams, lambda g: point(g, 1) * (1 << 42) + point(g, 2) * (1 << 21) + point(g, 3))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard of two texts' trigrams."""
    return jaccard(trigrams(a), trigrams(b))


def ordered_trigrams(text: Column) -> Column:
    """The trigrams of ``trigrams`` as they follow one another, repeats included."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))


def _best_extent(a: Column, b: Column) -> Column:
    """The largest similarity of a's trigram set with the trigrams of any continuous extent of b.

    Only extents that begin at a wanted trigram can be best. From each of these one fold goes to the end; a trigram counts where its
    last occurrence lies before the beginning.
    """

    def folded(places: Column, wanted: Column) -> Column:
        def step(acc: Column, x: Column, start: Column) -> Column:
            new = x["before"] < start
            seen, shared = acc["seen"] + new.cast("int"), acc["shared"] + (new & x["wanted"]).cast("int")
            return F.struct(seen.alias("seen"), shared.alias("shared"), F.greatest(acc["best"], shared / (wanted + seen - shared)).alias("best"))

        def from_start(start: Column) -> Column:
            zero = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("shared"), F.lit(0.0).alias("best"))
            return F.aggregate(F.slice(places, start, F.size(places)), zero, lambda acc, x: step(acc, x, start), lambda acc: acc["best"])

        starts = F.filter(F.transform(places, lambda x, i: F.when(x["wanted"], i + 1)), lambda i: i.isNotNull())
        return F.coalesce(F.array_max(F.transform(starts, from_start)), F.lit(0.0))

    def places(p: Column) -> Column:
        earlier = lambda g, i: F.array_position(F.reverse(F.slice(p["seq"], F.lit(1), i)), g).cast("int")
        before = lambda g, i: bind(earlier(g, i), lambda n: F.when(n == 0, F.lit(0)).otherwise(i - n + 1))
        made = F.transform(p["seq"], lambda g, i: F.struct(F.array_contains(p["want"], g).alias("wanted"), before(g, i).alias("before")))
        return bind(made, lambda x: folded(x, F.size(p["want"])))

    return bind(F.struct(trigrams(a).alias("want"), ordered_trigrams(b).alias("seq")), places)


def word_similarity(a: Column | str, b: Column | str) -> Column:
    """The better of both directions' extents; null where a text is null. Quadratic in a text's length: for pairs that are left over."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(_best_extent(a, b), _best_extent(b, a)))


def _extent(want: set[int], grams: list[int]) -> float:
    """_best_extent for one pair, over a matrix of beginnings by ends, some million cells of it at once."""
    wanted = np.fromiter((g in want for g in grams), bool, len(grams))
    at, starts = np.arange(len(grams)), np.flatnonzero(wanted)
    seen_at: dict[int, int] = {}
    before = np.empty(len(grams), np.int64)
    for i, g in enumerate(grams):
        before[i] = seen_at.get(g, -1)
        seen_at[g] = i
    best, rows = 0.0, max(1, (1 << 20) // max(1, len(grams)))
    for k in range(0, len(starts), rows):
        start = starts[k : k + rows, None]
        new = (before < start) & (at >= start)
        shared = np.cumsum(new & wanted, axis=1, dtype=np.int32)[:, starts]
        best = max(best, (shared / (len(want) + np.cumsum(new, axis=1, dtype=np.int32)[:, starts] - shared)).max())
    return best


@F.pandas_udf(T.DoubleType())
def gram_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """word_similarity of two texts' ordered trigrams as codes, for many pairs: some fifty times as fast as columns."""
    lists = [(x.tolist(), y.tolist()) for x, y in zip(a, b)]
    return pd.Series([max(_extent(set(x), y), _extent(set(y), x)) for x, y in lists], dtype=float)


def extract_scores(headline: Column) -> Column:
    """Scorelines as "low-high", from "6-5" and "Team 6, Team 5"; numbers over 250 and dates are no scores."""
    dash = F.regexp_extract_all(headline, F.lit(r"(?<![\d/-])(\d{1,3}\s?[-–]\s?\d{1,3})(?![\d/-])"), F.lit(1))
    side = r"[A-Z][\w.'’-]*(?: [A-Z][\w.'’-]*)*"
    line = F.regexp_extract_all(headline, F.lit(rf"\b({side} \d{{1,3}}, {side} \d{{1,3}})\b"), F.lit(1))
    line = F.transform(line, lambda m: F.regexp_replace(m, rf"^{side} (\d{{1,3}}), {side} (\d{{1,3}})$", "$1-$2"))
    pair = F.transform(F.concat(dash, line), lambda m: F.transform(F.split(m, r"\s?[-–]\s?"), lambda x: x.cast("int")))
    kept = F.filter(pair, lambda p: (p[0] <= 250) & (p[1] <= 250))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda p: F.concat_ws("-", F.least(p[0], p[1]).cast("string"), F.greatest(p[0], p[1]).cast("string")))))


def extract_amounts(headline: Column) -> Column:
    """Dollar amounts as whole dollars: "$15K" and "$15,000" are "$15000"."""
    found = F.regexp_extract_all(headline, F.lit(r"(?i)(\$\s?\d[\d,]*(?:\.\d+)?\s?(?:(?:million|billion|thousand|m|b|k)\b)?)"), F.lit(1))

    def whole(m: Column) -> Column:
        number = F.replace(F.regexp_extract(m, r"(\d[\d,]*(?:\.\d+)?)", 1), F.lit(","), F.lit("")).cast("double")
        unit = F.lower(F.regexp_extract(m, r"([A-Za-z]*)$", 1))
        factor = F.when(unit.isin("million", "m"), 1e6).when(unit.isin("billion", "b"), 1e9).when(unit.isin("thousand", "k"), 1e3).otherwise(1.0)
        return F.concat(F.lit("$"), F.floor(number * factor + 0.5).cast("string"))

    return F.array_sort(F.array_distinct(F.transform(found, whole)))


def normalize_variant(headline: Column) -> Column:
    """Wording without case, publisher suffix and punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(headline), fixed.SOURCE_SUFFIX, ""), "[^a-z0-9]+", " "))


def is_usable_headline(headline: Column) -> Column:
    """20 to 220 characters, no ellipsis, no site suffix."""
    return F.length(headline).between(20, 220) & ~headline.rlike(r"(…|\.\.\.)") & ~headline.rlike(r"\s[|–—]\s")


def bind(value: Column, body) -> Column:
    """``body`` of a value computed once: inside a lambda a plain expression would be computed anew for every element."""
    return F.transform(F.array(value), body)[0]


def phrases(text: Column, most_words: int = 4, firsts: Column | None = None) -> Column:
    """Every run of one to ``most_words`` words with what stands between them, as written: whole-word search by set intersection.

    ``firsts``: lower-cased words; only runs that begin with one of them, so that few words of a long text make runs at all.
    """

    def runs(pieces: Column, begins) -> Column:
        at = F.filter(F.transform(pieces, lambda p, i: F.when(begins(p), i + 1)), lambda i: i.isNotNull())
        return F.flatten(F.transform(at, lambda i: F.transform(F.array(*[F.lit(2 * k + 1) for k in range(most_words)]), lambda n: F.array_join(F.slice(pieces, i, n), ""))))

    def chosen(pieces: Column) -> Column:
        here = F.array_intersect(firsts, F.transform(pieces, F.lower))
        return bind(here, lambda h: F.when(F.size(h) > 0, runs(pieces, lambda p: F.array_contains(h, F.lower(p)))).otherwise(F.array().cast("array<string>")))

    every = lambda pieces: runs(pieces, lambda p: p.rlike(r"^[\p{L}\p{N}]"))
    return F.array_distinct(bind(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1)), every if firsts is None else chosen))


def first_word(term: Column) -> Column:
    """The word that a run of words equal to ``term`` begins with, in lower case."""
    return F.regexp_extract(F.lower(term), r"^[\p{L}\p{N}]+", 0)


def decode_entities(text: Column) -> Column:
    """The six named entities that titles use; ampersands last, so that nothing is decoded twice."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text
