"""The phrase dictionary against term search by expressions."""

import random

from pyspark.sql import functions as F

from tickerloom.functions import classify, fixed, text
from tickerloom.operators import terms


def test_dictionary_equals_expressions(spark):
    rng = random.Random(3)
    words = [r[4] for r in terms.dictionary_rows()] + ["the", "lawyers", "cement", "Special Olympics", "fraud", "x-ray", "HEAT", "heat", "u.s.", "über"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", ", ", "-", "'s ", "\n"]) for _ in range(rng.randrange(0, 9)))) for i in range(300)] + [(900, None), (901, ""), (None, "NBA")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.sport): (r.score, r.strong, r.team, r.weak) for r in terms.term_evidence(df, "doc_id", "text").collect()}
    kept = df.filter("doc_id is not null and text is not null")
    want = {(r.doc_id, e.sport): (e.score, e.strong, e.team, e.weak) for r in classify.with_evidence(kept, "text").select("doc_id", "evidence").collect() for e in r.evidence if e.score}
    assert got == want and len({s for _, s in got}) == len(fixed.PROFILE_TERMS)


def test_plan_does_not_grow_with_the_lexicon(spark):
    df = spark.createDataFrame([(1, "NBA")], "doc_id long, text string")
    small = terms.dictionary(spark).filter(F.col("sport") == "golf")
    size = lambda known: len(terms.term_evidence(df, "doc_id", "text", known)._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert abs(size(small) - size(terms.dictionary(spark))) <= 2


def test_only_runs_that_begin_a_term_are_made(spark):
    """A long text's runs by a term's first word: those of all its runs, and none where no term begins."""
    rng = random.Random(5)
    words = ["NBA", "nba", "Trail", "Blazers", "the", "x-ray", "über", "ÜBER", "7", "__", "don't"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(rng.randrange(0, 40)))) for i in range(200)] + [(900, None), (901, ""), (902, " the ... the")]
    df = spark.createDataFrame(rows, "id int, t string")
    firsts = F.array(*[F.lit(w) for w in ("nba", "trail", "über")])
    begin = lambda run: F.array_contains(firsts, text.first_word(run))
    got = df.select("id", text.phrases(F.col("t"), 3, firsts).alias("got"), F.filter(text.phrases(F.col("t"), 3), begin).alias("want")).collect()
    assert all(r.got == r.want for r in got if r.id != 900) and sum(len(r.got) for r in got if r.got) > 500
    assert next(r.got for r in got if r.id == 902) == [] and terms.term_evidence(df.filter("id >= 900"), "id", "t").isEmpty()
