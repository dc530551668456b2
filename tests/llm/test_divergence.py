"""The divergence audit against a plain loop, and its tiles against the plain sum."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from tickerloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, g string, rank int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=3, most=200):
    docs = [((lang or ""), (source or ""), Counter(TERM.findall((text or "").translate(LOWER)))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        within = Counter(t for d in docs if d[0] == lang for t in d[2])
        kept = sorted(t for t, n in within.items() if n >= least)
        groups = defaultdict(Counter)
        for d in docs:
            if d[0] == lang:
                groups[d[1]].update(d[2])
        whole = sum((c for c in groups.values()), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        shares, q = {s: share(c) for s, c in groups.items()}, share(whole)
        far = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            pairs = [(o, sum(far(shares[s][t], shares[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, far(shares[s][t], q[t])) for t in kept if groups[s][t] and shares[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, len(pairs)), ("term", terms, most)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found[:limit], 1)]
    return sorted(out)


def corpus(seed=2, n=150):
    rng = random.Random(seed)
    words = ["the", "Über", "naïve", "ça", "x1y", "日本", "a-b", "É", "don't", "zz", "\x7f", "alpha", "beta", "İx"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(5)]
    rows = []
    for _ in range(n):
        source = "hot" if rng.random() < 0.4 else f"s{rng.randrange(12)}"
        rows.append((" ".join(rng.choice(words[: rng.randrange(4, len(words))]) for _ in range(rng.randrange(0, 40))), rng.choice(["en", "en", "fr", None]), source))
    rows += [(None, "en", "s1"), ("", "de", "a"), ("only here", "de", "b"), (None, None, None), ("Long " * 400_000, "en", "long"), ("q" * 3_000_000, "en", "s2"), ("1 2 3", "xx", "lone"), ("ä ö", "en", "ä"), ("the", "en", "Z")]
    return rows + rows[:5]


def test_audit_equals_the_loop(spark):
    rows = corpus()
    table = spark.createDataFrame([(i, *r, "clash", 1, "g", 2) for i, r in enumerate(rows)], SCHEMA).repartition(5)
    got = sorted(tuple(r) for r in divergence.audit_sources(table).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == brute(rows)
    assert divergence.audit_sources(table, most_terms=3).filter("part = 'term' and rank > 3").isEmpty()
    assert divergence.audit_sources(spark.createDataFrame([], SCHEMA)).count() == 0


def test_audit_equals_the_loop_in_small_tiles(spark, monkeypatch):
    for name, value in (("TILE_TERMS", 7), ("PAIR_GROUPS", 4), ("HELD", 11), ("CHUNK", 50)):
        monkeypatch.setattr(divergence, name, value)
    rows = corpus(9, 80)
    table = spark.createDataFrame([(i, *r, "clash", 1, "g", 2) for i, r in enumerate(rows)], SCHEMA).repartition(3)
    assert sorted(tuple(r) for r in divergence.audit_sources(table).select("lang", "source", "part", "item", "value", "rank").collect()) == brute(rows)


def test_sql_equals_the_loop():
    rows = corpus(5)
    c = duckdb.connect()
    c.register("documents", pd.DataFrame([(i, *r) for i, r in enumerate(rows)], columns=["doc_id", "text", "lang", "source"]))
    got = c.sql(divergence.oracle()).fetchall()
    assert sorted(tuple(r) for r in got) == brute(rows)


@pytest.mark.parametrize("seed", range(12))
def test_tile_sums(seed):
    rng = np.random.default_rng(seed)
    groups, terms = int(rng.integers(1, 30)), int(rng.integers(1, 60))
    base = rng.integers(1, 10**5, groups)
    full = np.repeat(base[:, None], terms, 1)
    held = rng.random((groups, terms)) < rng.choice([0.05, 0.3, 0.9], terms)
    held[rng.integers(groups), :] = True
    of, term = np.nonzero(held)
    p = rng.choice([*rng.integers(1, 10**9, 5), 10**9 + 1], len(of))
    full[of, term] = p
    want = np.array([[sum((int(a) - int(b)) ** 2 // int(b) for a, b in zip(full[g], full[h])) for h in range(groups)] for g in range(groups)], object)
    for at in range(0, groups, 7):
        got = divergence.tile_sums(base, of, term, p, terms, slice(at, at + 7))
        off = np.arange(groups)[at : at + 7][:, None] != np.arange(groups)[None, :]
        assert (got[off] == want[at : at + 7][off]).all()


def test_share_is_exact_beyond_a_long_product(spark):
    from pyspark.sql import functions as F

    pairs = [(n, t) for t in (1, 7, 10**6, 10**10 + 7, 9 * 10**15) for n in (0, 1, t // 3, t - 1) if n < t]
    got = spark.createDataFrame(pairs, "n long, t long").select("n", "t", divergence.share(F.col("n"), F.col("t")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.n + 1) // r.t for r in got)
