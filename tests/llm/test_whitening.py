"""Whitening against exact fractions and a plain decomposition."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tickerloom.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int, x string, n long"


def brute(rows):
    """n, S and covariance (as fractions) of distinct integer vectors, and each row's deviation."""
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    size = max({len(v) for _, v in usable}, key=lambda k: (sum(len(v) == k for _, v in usable), k))
    ints = [(i, tuple(max(-(2**63), min(2**63 - 1, math.floor(256 * Fraction(c)))) for c in v)) for i, v in usable if len(v) == size]
    fit = sorted({x for _, x in ints})
    n, s = len(fit), [sum(x[d] for x in fit) for d in range(size)]
    centred = [[Fraction(n * x[d] - s[d], n) for d in range(size)] for x in fit]
    cov = [[sum(c[i] * c[j] for c in centred) / n for j in range(size)] for i in range(size)]
    return ints, n, s, cov, [(i, sum((n * x[d] - s[d]) ** 2 for d in range(size))) for i, x in ints]


def check(spark, rows, tolerance=1e-9):
    table = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA).repartition(3)
    got = whitening.whiten(table).collect()
    ints, n, s, cov, deviations = brute(rows)
    k = min(4, len(s))
    values, vectors = np.linalg.eigh(np.array(cov, float))
    order = np.argsort(-values)[:k]
    assert len(got) == k * len(ints) and {r.n for r in got} == {n}
    assert sorted((r.vec_id or -1, int(r.deviation_text)) for r in got if r.component == 1) == sorted((i or -1, d) for i, d in deviations)
    assert all(r.deviation == (int(r.deviation_text) if int(r.deviation_text) < 2**63 else None) for r in got)
    trace = float(sum(cov[d][d] for d in range(len(s))))
    for c, at in enumerate(order, 1):
        mine = [r for r in got if r.component == c]
        if values[at] <= 1e-12 * max(values.max(), 1e-300):
            assert all(r.whitened is None for r in mine)
            continue
        assert all(abs(r.explained - values[at] / trace) <= 1e-9 * r.explained for r in mine)
        want = sorted((i or -1, float(np.dot([float(Fraction(n * x[d] - s[d], n)) for d in range(len(s))], vectors[:, at])) / math.sqrt(values[at])) for i, x in ints)
        have = sorted((r.vec_id or -1, r.whitened) for r in mine)
        direct = max(abs(a[1] - b[1]) for a, b in zip(want, have))
        flipped = max(abs(a[1] - b[1]) for a, b in zip(sorted((i, -w) for i, w in want), have))
        assert min(direct, flipped) < tolerance
        assert all(r.identity_error < 1e-4 for r in mine)
    return got


def test_whitening_equals_fractions(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, s) + m for s, m in ((2, 0), (1, 5), (0.5, -3), (0.25, 0), (0.1, 9))]) for i in range(80)]
    rows += [(100 + i, rows[0][1]) for i in range(40)] + [(3, rows[3][1]), (None, rows[4][1])]
    rows += [(200, None), (201, [None, 1.0, 1.0, 1.0, 1.0]), (202, [float("nan")] * 5), (203, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (204, [0.0] * 5), (205, [1.0, 2.0]), (206, []), (207, [-0.0] * 5)]
    check(spark, rows)


def test_whitening_far_from_the_origin_and_beyond_a_long(spark):
    rng = random.Random(4)
    check(spark, [(i, [1e12 + rng.random(), -3e11 + 2 * rng.random(), rng.random()]) for i in range(60)])
    wide = [(i, [rng.choice((1e300, -1e300, 3e15)) * rng.random(), rng.gauss(0, 1e14), rng.gauss(0, 3e14)]) for i in range(50)]
    got = check(spark, wide, 1e-6)
    assert any(r.deviation is None for r in got)


def test_whitening_without_spread(spark):
    got = check(spark, [(i, [1.0, 2.0]) for i in range(5)])
    assert {(r.whitened, r.explained, r.identity_error, r.deviation) for r in got} == {(None, None, None, 0)}
    line = check(spark, [(i, [float(i), 2.0 * i, -1.0 * i, 0.0, 1.0]) for i in range(9)])
    assert {r.explained for r in line if r.component > 1} == {0.0}
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 0, "x", 1)], SCHEMA)).count() == 0


@pytest.mark.parametrize("spread", [1, 2**18, 2**19, 2**20, 2**40, 2**62])
def test_scatter_is_exact(spread):
    rng = np.random.default_rng(spread % 97)
    x = rng.integers(-spread, spread, (9000, 3))
    x[0], x[1] = -spread, spread - 1
    shift = x[5]
    total = whitening.Scatter(shift)
    total.add(x[:5000])
    total.add(x[5000:])
    y = x.astype(object) - shift.astype(object)
    assert (total.products == y.T @ y).all() and (total.sums == y.sum(0)).all() and total.n == 9000
