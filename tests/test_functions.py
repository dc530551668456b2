"""Tables of small cases for the column functions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickerloom.functions import classify, text, times, urls
from tickerloom.operators import intake


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://www.Example.com:443/A/b?utm_source=x&b=2#top", "https://www.example.com/A/b?b=2"),
        ("http://m.example.co.uk", "http://m.example.co.uk/"),
        ("http://example.com/?UTM_Medium=1", "http://example.com/"),
        ("http://example.com/a?", "http://example.com/a"),
        ("ftp://example.com/a", None),
        ("not a url", None),
        (None, None),
    ],
)
def test_normalize_url(spark, url, want):
    assert one(spark, urls.normalize_url(F.lit(url).cast("string"))) == want


@pytest.mark.parametrize(("host", "want"), [("espn.com", "known"), ("www2.espn.com", "known"), ("notespn.com", "unknown"), ("a.fanduel.com", "low-quality"), ("x.org", "unknown")])
def test_source_quality(spark, host, want):
    assert one(spark, urls.source_quality(F.lit(host))) == want


def test_normalize_headline(spark):
    assert one(spark, text.normalize_headline(F.lit("  “Ｃubs” — top​ Reds…  "))) == '"cubs" - top reds...'
    assert one(spark, text.normalize_headline(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize(
    ("title", "want"),
    [("One two three | Site", "One two three"), ("One two | Site", "One two | Site"), ("Cubs beat the Reds - Example Daily News", "Cubs beat the Reds"), ("Cubs beat the Reds - and then lose", "Cubs beat the Reds - and then lose")],
)
def test_strip_site_suffix(spark, title, want):
    assert one(spark, text.strip_site_suffix(F.lit(title))) == want


def test_scores_and_amounts(spark):
    assert one(spark, text.extract_scores(F.lit("Angels 6, Twins 5; then 110-102 on 2024-01-02"))) == ["102-110", "5-6"]
    assert one(spark, text.extract_amounts(F.lit("$15K or $15,000, then $1.5 million"))) == ["$15000", "$1500000"]
    assert one(spark, text.content_tokens(F.lit("José's six wins over the Reds – Example News"))) == ["jose", "6", "wins", "reds"]


def brute_trigrams(s):
    out, word = set(), ""
    for c in s.lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            p = f"  {word} "
            out |= {p[i : i + 3] for i in range(len(p) - 2)}
            word = ""
    return out


@pytest.mark.parametrize(("a", "b"), [("foo bar", "foo baz"), ("word", "two words"), ("", "x"), ("a", "a"), ("Mets-Reds 5", "reds 5 mets")])
def test_similarity(spark, a, b):
    x, y = brute_trigrams(a), brute_trigrams(b)
    want = len(x & y) / len(x | y) if x | y else 0.0
    assert one(spark, text.similarity(F.lit(a), F.lit(b))) == pytest.approx(want)


def test_word_similarity(spark):
    df = spark.createDataFrame([("word", "two words")], "a string, b string")
    assert df.select(text.word_similarity("a", "b")).first()[0] == pytest.approx(0.8)


def test_times(spark):
    ts = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, F.round(times.recency_points(F.lit(2.0), F.lit(2.0)), 2)) == 49.93
    assert one(spark, times.parse_stamp(F.lit("20240230000000"))) is None
    assert one(spark, times.parse_stamp(F.lit("20240229101500"))) == dt.datetime(2024, 2, 29, 10, 15)
    assert one(spark, times.stamp_distance(ts("2024-01-01 01:00"), ts("2024-01-01 00:00"))) == 4
    assert len(one(spark, times.recent_stamps(ts("2024-01-01 01:00"), 3))) == 3
    assert [times.window_file_count(w) for w in ("15min", "3h", "3d", "x")] == [2, 12, 24, 4]
    with pytest.raises(ValueError, match="window"):
        times.window_hours("3 hours")


@pytest.mark.parametrize(
    ("headline", "sport", "confidence", "kind"),
    [
        ("Lakers beat Celtics 110-102 in NBA opener", "basketball", "high", "game-result"),
        ("Trail Blazers waive guard", "basketball", "medium", "transaction"),
        ("Chiefs will beat Bills tonight", "football", "medium", "preview"),
        ("SEC charges fraud at firm", "unknown", "none", None),
        ("MAVS TRADE STAR FOR NBA PICKS", "basketball", "high", "trade"),
        ("Special Olympics open downtown", "unknown", "none", None),
        ("Storm hits the coast", "unknown", "none", None),
    ],
)
def test_classify(spark, headline, sport, confidence, kind):
    df = classify.with_features(classify.classify(spark.createDataFrame([(headline,)], "headline string")))
    row = df.select("sport", "confidence", "features.event_type").first()
    assert (row.sport, row.confidence, row.event_type) == (sport, confidence, kind)


@pytest.mark.parametrize(
    ("headline", "url", "language", "want"),
    [
        ("Cubs beat the Reds in ten innings", "https://a.com/x", "en", []),
        ("Hi you", "https://a.com/", None, ["malformed-headline", "generic-page"]),
        ("Best bets for the game tonight", "https://a.com/x", "en", ["betting-or-fantasy"]),
        ("Team wins against all odds again", "https://a.com/x", "en", []),
        ("Highlights: Cubs against the Reds", "https://a.com/watch/1", "es", ["non-english", "video-page"]),
        (None, None, None, ["malformed-headline", "generic-page"]),
    ],
)
def test_intake(spark, headline, url, language, want):
    df = spark.createDataFrame([(headline, url, language)], "h string, u string, l string")
    got = df.select(intake.reject_reasons(F.col("h"), F.col("u"), F.col("l"), F.lit(None).cast("array<string>"), F.lit("high"), F.lit("unknown"))).first()[0]
    assert got == want


def plain_extent(a, b):
    def grams(t):
        words = "".join(c if c.isalnum() else " " for c in t.lower()).split()
        return [f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)]

    want, seq = set(grams(a)), grams(b)
    best = 0.0
    for start in range(len(seq)):
        seen = set()
        for gram in seq[start:]:
            seen.add(gram)
            best = max(best, len(seen & want) / len(seen | want))
    return best if want else 0.0


def test_word_similarity_equals_the_loop(spark):
    import random

    rng = random.Random(9)
    words = ["Lakers", "beat", "Celtics", "110-102", "the", "the", "in", "überraschung", "naïve", "O'Neal", "aaa", "aaaa", "banana", "-", "x"]
    some = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))) for _ in range(90)] + [None, "", "!!"]
    rows = [(k, rng.choice(some), rng.choice(some)) for k in range(5000)]
    got = spark.createDataFrame(rows, "k long, a string, b string").repartition(4).select("k", text.word_similarity("a", "b").alias("s"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    found = {r.k: r.s for r in got.collect()}
    known = {}
    for k, a, b in rows:
        if a is None or b is None:
            assert found[k] is None
            continue
        if (a, b) not in known:
            known[a, b] = max(plain_extent(a, b), plain_extent(b, a))
        assert found[k] == pytest.approx(known[a, b], abs=1e-12), (a, b)
