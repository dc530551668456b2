"""Near duplicates among embeddings against all pairs."""

import numpy as np
import pytest

from tickerloom.llm import embedding_dedup as dedup

SCHEMA = "vec_id long, embedding array<float>, label int, node string, n string, cells string"


def brute(rows, cosine=0.9):
    size = {}
    usable = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v) and i is not None for i, v in rows]
    for (_, v), u in zip(rows, usable):
        if u:
            size[len(v)] = size.get(len(v), 0) + 1
    dim = max(size, key=lambda k: (size[k], k)) if size else 0
    at = [k for k, (_, v) in enumerate(rows) if usable[k] and len(v) == dim]
    links = {k: set() for k in range(len(rows))}
    if at:
        x = np.array([rows[k][1] for k in at], np.float32).astype(float)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        for a, b in zip(*np.nonzero(x @ x.T >= cosine)):
            if a != b:
                links[at[a]].add(at[b])
    component = {}
    for k in range(len(rows)):
        if k not in component:
            group, todo = {k}, [k]
            while todo:
                for other in links[todo.pop()] - group:
                    group.add(other)
                    todo.append(other)
            ids = [rows[g][0] for g in group if rows[g][0] is not None]
            component |= dict.fromkeys(group, min(ids) if ids else None)
    return sorted(((i, len(links[k]), component[k], i is not None and i == component[k]) for k, (i, _) in enumerate(rows)), key=str), sum(map(len, links.values()))


def run(spark, rows, partitions=4, **more):
    table = spark.createDataFrame([(i, v, 0, "x", "y", "z") for i, v in rows], SCHEMA).repartition(partitions)
    got = dedup.near_duplicates(table, **more).collect()
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str)


def vectors(seed, n, dim, groups, spread=(0.05, 0.4)):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dim) for _ in range(n)]
    for size in groups:
        centre = rng.normal(size=dim)
        rows += [centre + rng.uniform(*spread) * rng.normal(size=dim) for _ in range(size)]
    order = rng.permutation(len(rows))
    return [(int(i) * 3, [float(np.float32(c)) for c in rows[int(k)]]) for i, k in enumerate(order)]


def test_whole_traversal_equals_all_pairs(spark):
    rows = vectors(1, 150, 12, (40, 7, 2, 2), (0.05, 0.5))
    same = rows[5][1]
    rows += [(5000 + i, same) for i in range(60)] + [(rows[3][0], rows[3][1]), (rows[3][0], [float(c) for c in np.ones(12)]), (None, same)]
    rows += [(6000, None), (6001, [0.0] * 12), (6002, [float("nan")] * 12), (6003, [None] * 12), (6004, []), (6005, [1.0] * 5), (6006, [float("inf")] * 12), (6007, [2 * c for c in same]), (6008, [-c for c in same])]
    want, _ = brute(rows)
    assert run(spark, rows, recall=1.0) == want


def test_blocks_and_both_directions_count_each_pair_once(spark, monkeypatch):
    for name in ("LEAST_RESIDENTS", "MOST_RESIDENTS", "LEAST_VISITORS", "MOST_VISITORS"):
        monkeypatch.setattr(dedup, name, 9)
    rows = vectors(2, 120, 8, (90, 20, 3), (0.05, 0.3))
    got = run(spark, rows)
    want, total = brute(rows)
    assert all(g[1] <= w[1] for g, w in zip(sorted(got), sorted(want)))
    assert sum(g[1] for g in got) >= 0.9 * total and sum(g[1] for g in got) % 2 == 0


@pytest.mark.parametrize("seed", range(2))
def test_recall_at_the_hardest_cosine(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    y = 0.903 * x + np.sqrt(1 - 0.903**2) * away
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(np.concatenate([x, y]))]
    want, total = brute(rows)
    got = run(spark, rows)
    assert total >= 2900 and sum(g[1] for g in got) >= 0.95 * total
    assert all(g[1] <= w[1] for g, w in zip(sorted(got), sorted(want)))


def test_empty_and_hopeless_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, [0.0])]) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert run(spark, [(4, [1.0]), (2, [3.0]), (3, [-1.0])]) == [(2, 1, 2, True), (3, 0, 3, True), (4, 1, 2, False)]


def test_traversal_is_the_order_of_summed_distances():
    rng = np.random.default_rng(0)
    index = dedup.MultiIndex(rng.normal(size=(7, 3)), rng.normal(size=(5, 4)))
    u = rng.normal(size=(40, 7))
    a, b = index.distances(u)
    for visits in (1, 2, 5, 12, 35, 99):
        got = index.traverse(u, visits)
        want = np.argsort((a[:, :, None] + b[:, None, :]).reshape(len(u), -1), 1, kind="stable")[:, : min(visits, 35)]
        assert (got == want).all()
