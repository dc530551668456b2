"""Term search by a phrase dictionary: one broadcast hash table of all sports' terms, one pass over a text's phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions import fixed, text

POINTS = {"strong": 3, "team": 2, "weak": 1}


def dictionary_rows() -> list[tuple[str, int, str, int, str, str, bool, str | None]]:
    """(sport, place of the sport, tier, place of the term, term, key in lower case, whether case counts, guard) of the whole lexicon."""
    rows = []
    for at, sport in enumerate(fixed.PROFILE_TERMS):
        own = fixed.LEXICON.get(sport, {"strong": [], "team": [], "weak": []})
        for tier in POINTS:
            terms = fixed.PROFILE_TERMS[sport] + own["strong"] if tier == "strong" else own[tier]
            for place, term in enumerate(dict.fromkeys(terms)):
                cased = tier != "strong" and len(term) > 1 and term[0].isupper() and term[1].islower() and term[:2].isascii()
                rows.append((sport, at, tier, place, term, term.lower(), cased, fixed.TERM_GUARDS.get(term)))
    return rows


def dictionary(spark: SparkSession) -> DataFrame:
    """The lexicon as a table; its size is that of the lexicon, whatever the texts."""
    return spark.createDataFrame(dictionary_rows(), "sport string, sport_place int, tier string, place int, term string, key string, cased boolean, guard string")


def term_evidence(texts: DataFrame, id_column: str, text_column: str, terms: DataFrame | None = None, most_words: int = 4) -> DataFrame:
    """(id, sport, score, strong, team, weak) of each text and each sport with a term in it; terms in the lexicon's order.

    A term counts once, as whole words; capitalised team and weak terms as they are written, others in any case; a guarded one only where
    its guard is not in the text. Phrases that only look like sports are taken out first. Phrases of up to ``most_words`` words that begin
    with some term's first word are exploded and meet the dictionary by hash, so the plan is the same for any number of terms. Null texts and ids have no evidence. Rows
    of one id count together.
    """
    neutral = F.col(text_column)
    for phrase in fixed.NEUTRAL_PHRASES:
        neutral = F.regexp_replace(neutral, f"(?i){phrase}", " ")
    terms = terms if terms is not None else dictionary(texts.sparkSession)
    known, firsts = F.broadcast(terms), F.broadcast(terms.agg(F.collect_set(text.first_word(F.col("key"))).alias("__firsts")))
    t = texts.select(F.col(id_column).alias(id_column), neutral.alias("__text")).filter(F.col(id_column).isNotNull())
    runs = t.crossJoin(firsts).select(id_column, "__text", F.explode(text.phrases(F.col("__text"), most_words, F.col("__firsts"))).alias("run"))
    met = runs.join(known, F.lower("run") == F.col("key")).filter((~F.col("cased") | (F.col("run") == F.col("term"))) & (F.col("guard").isNull() | ~F.rlike("__text", F.col("guard"))))
    found = met.groupBy(id_column, "sport", "sport_place").agg(F.collect_set(F.struct("tier", "place", "term")).alias("hits"))  # the lexicon's size at most
    of = lambda tier: F.transform(F.array_sort(F.filter("hits", lambda h: h["tier"] == tier)), lambda h: h["term"])
    out = found.select(id_column, "sport", "sport_place", *[of(tier).alias(tier) for tier in POINTS])
    score = sum((F.size(tier) * points for tier, points in POINTS.items()), F.lit(0))
    return out.select(id_column, "sport", score.alias("score"), *POINTS)
