"""Approximate nearest neighbours in learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts; a small classifier learns which parts hold a vector's
neighbours. It places every row in one part and sends each query to its most probable parts, where exact cosines decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.common import materialize

#: Vectors that graph and classifier are fitted on: one in ROWS_PER_SAMPLED, within these bounds; each part has SAMPLE_PER_PART of them.
LEAST_SAMPLE, MOST_SAMPLE, ROWS_PER_SAMPLED, SAMPLE_PER_PART = 6000, 32_000, 16, 128
#: Share of true neighbours that the number of probed parts must find, among sampled vectors that neither graph nor classifier has seen.
RECALL = 0.95
#: Rows of one block of a part, and of one block of queries, at most.
BLOCK_ROWS, QUERY_ROWS = 16_384, 4_096


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k most similar other rows of each row of unit vectors, by blocks."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        cosine = x[at : at + 1024] @ x.T
        cosine[np.arange(len(cosine)), at + np.arange(len(cosine))] = -2
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        out[at : at + 1024] = np.take_along_axis(near, np.argsort(-np.take_along_axis(cosine, near, 1), axis=1, kind="stable"), 1)
    return out


def balanced_parts(graph: np.ndarray, x: np.ndarray, parts: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Parts of equal size (within one) that keep neighbours together: median splits, then swaps that cut fewer edges."""
    rng = np.random.default_rng(seed)
    n = len(x)
    smooth = x + x[graph].mean(1)
    part = np.zeros(n, np.int64)
    work = [(np.arange(n), 0, parts)]
    while work:
        rows, first, count = work.pop()
        if count == 1:
            part[rows] = first
            continue
        low = count // 2
        here = smooth[rows] - smooth[rows].mean(0)
        axis = rng.normal(size=x.shape[1])
        for _ in range(6):  # power iteration: the direction along which these rows differ most
            axis = here.T @ (here @ axis)
            axis /= max(np.linalg.norm(axis), 1e-12)
        order = np.argsort(here @ axis, kind="stable")
        cut = round(len(rows) * low / count)
        work += [(rows[order[:cut]], first, low), (rows[order[cut:]], first + low, count - low)]
    votes = np.zeros((n, parts), np.int32)
    for _ in range(rounds):
        votes[:] = 0
        np.add.at(votes, (np.arange(n)[:, None], part[graph]), 1)
        np.add.at(votes, (graph, part[:, None]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        moved = 0
        wish: dict[tuple[int, int], list[int]] = {}
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            a, b = int(part[v]), int(best[v])
            if waiting := wish.get((b, a)):  # one that wants the other way: swapping keeps sizes
                u = waiting.pop(0)
                part[v], part[u] = b, a
                moved += 1
            else:
                wish.setdefault((a, b), []).append(int(v))
        if not moved:
            break
    return part


@dataclass
class Router:
    """A network of one hidden layer from unit vectors to parts, and the number of parts to probe."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.logits(x).argmax(1)

    def probed(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, : self.probes]


def train_router(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 25, rate: float = 3e-3, seed: int = 5) -> Router:
    """Cross entropy to the shares of a vector's neighbours by part; Adam."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, target.shape[1])), np.zeros(target.shape[1])]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            pre = x[rows] @ p[0] + p[1]
            act = np.maximum(pre, 0)
            out = act @ p[2] + p[3]
            d = np.exp(out - out.max(1, keepdims=True))
            d = (d / d.sum(1, keepdims=True) - target[rows]) / len(rows)
            back = (d @ p[2].T) * (pre > 0)
            step += 1
            for k, g in enumerate((x[rows].T @ back, back.sum(0), act.T @ d, d.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Router(*p)


def fit_router(x: np.ndarray, recall: float = RECALL, k: int = 5, seed: int = 3) -> Router:
    """Graph, parts and classifier on two thirds of sampled unit vectors; probes are counted on the last third.

    There both queries and their neighbours are new to the classifier, as almost all rows of a large table are.
    """
    n = len(x)
    order = np.random.default_rng(seed).permutation(n)
    unseen, seen = x[order[: n // 3]], x[order[n // 3 :]]
    parts = len(seen) // SAMPLE_PER_PART
    if parts <= 1:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    graph = neighbour_graph(seen, min(10, len(seen) - 1))
    part = balanced_parts(graph, seen, parts)
    target = np.zeros((len(seen), parts))
    np.add.at(target, (np.arange(len(seen))[:, None], part[graph]), 1.0)
    target[np.arange(len(seen)), part] += 1
    target /= target.sum(1, keepdims=True)
    router = train_router(seen, target)
    logits = router.logits(unseen)
    place = np.argsort(np.argsort(-logits, axis=1, kind="stable"), axis=1)  # place[q, p]: how manieth part p is for query q
    needed = place[np.arange(len(unseen))[:, None], logits.argmax(1)[neighbour_graph(unseen, min(k, len(unseen) - 1))]]
    found = np.array([(needed < m).mean() for m in range(1, parts + 1)])
    router.probes = int(np.argmax(found >= recall)) + 1 if (found >= recall).any() else parts
    return router


def _usable(e: Column) -> Column:
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return e.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(e, lambda v: v != 0)


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in double precision as they are, and their unit vectors."""
    flat = column.flatten() if len(column) else pa.array([], pa.float64())
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    # scaling by the largest component first: squares of tiny or huge numbers would leave the range
    scaled = x / np.maximum(np.abs(x).max(1, keepdims=True), np.finfo(float).tiny) if len(x) else x
    return x, scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def nearest(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k nearest other rows by cosine among those found.

    ``is_query`` makes a condition of the id column. Equal vectors are searched once: of each, the k + 1 smallest ids stand for all
    (a query's result cannot hold more of them), so a vector that a third of the rows share is no hot spot; parts beyond
    BLOCK_ROWS or one and a quarter times the mean are dealt out in blocks. Null, zero and non-finite vectors take no part, nor
    do vectors of another length than the most common (of several, the largest) or with a null id. Ties go to the smaller
    id. Rows with one id are one candidate each; a query never finds its own id. No usable vectors: no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & _usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).limit(1).collect()
    dim = lengths[0]["n"] if lengths else 1
    rows = rows.filter(F.size("v") == dim).withColumn("h", F.xxhash64("v"))

    in_group = Window.partitionBy("h", "v").orderBy("id")
    members = rows.withColumn("nth", F.row_number().over(in_group)).filter(F.col("nth") <= k + 1)
    groups = materialize(members.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "vectors")
    n_sample = min(max(groups.count() // ROWS_PER_SAMPLED, LEAST_SAMPLE), MOST_SAMPLE)
    sample = groups.orderBy(F.xxhash64("h"), "h").limit(n_sample).select("h", "v").toArrow().sort_by("h")
    _, x = _unit(sample["v"].combine_chunks(), dim)
    router = spark.sparkContext.broadcast(fit_router(x, recall, k) if len(x) else None)

    def placed(batches: Iterator[pa.RecordBatch], query: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, unit = _unit(batch.column("v"), dim)
            model = router.value
            parts = model.probed(unit) if query else model.home(unit)[:, None]
            row, part = np.repeat(np.arange(len(x)), parts.shape[1]), parts.ravel()
            vec = pa.array([x[i].tobytes() for i in range(len(x))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row)), pa.array(part, pa.int32()), vec.take(pa.array(row))], ["key", "part", "vec"])

    keys = groups.select(F.col("ids")[0].alias("key"), "v", "ids")
    index = materialize(
        keys.select("key", "v").mapInArrow(lambda b: placed(b, False), "key long, part int, vec binary").join(keys.select("key", "ids"), "key"), "index"
    )
    queries = rows.filter(is_query(F.col("id")))
    asked = queries.groupBy("h", "v").agg(F.min("id").alias("key"))
    routed = materialize(asked.select("key", "v").mapInArrow(lambda b: placed(b, True), "key long, part int, vec binary"), "queries")

    # Blocks by part: a few numbers a part.
    sizes = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}
    wanted = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}
    most = min(BLOCK_ROWS, int(1.25 * sum(sizes.values()) / max(len(sizes), 1)) + 1)
    blocks = F.create_map(*[F.lit(int(v)) for p, n in sizes.items() for v in (p, -(-n // most))]) if sizes else F.create_map(F.lit(0), F.lit(1))
    query_blocks = F.create_map(*[F.lit(int(v)) for p, n in wanted.items() for v in (p, -(-n // QUERY_ROWS))]) if wanted else F.create_map(F.lit(0), F.lit(1))
    n_blocks, n_query_blocks = F.coalesce(blocks[F.col("part")], F.lit(1)), F.coalesce(query_blocks[F.col("part")], F.lit(1))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = routed.withColumn("qb", F.pmod(F.xxhash64("key"), n_query_blocks).cast("int")).withColumn("cb", each(n_blocks))
    right = index.withColumn("cb", F.pmod(F.xxhash64("key"), n_blocks).cast("int")).withColumn("qb", each(n_query_blocks))

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"key": [], "id": [], "score": []}
        if len(q) and len(c):
            a = np.frombuffer(b"".join(q["vec"]), np.float64).reshape(len(q), dim)
            b = np.frombuffer(b"".join(c["vec"]), np.float64).reshape(len(c), dim)
            unit = lambda m: (s := m / np.abs(m).max(1, keepdims=True)) / np.sqrt((s * s).sum(1, keepdims=True))
            a, b = unit(a), unit(b)
            take = min(len(b), 2 * k + 2)
            ids, keys_of = c["ids"].to_numpy(), q["key"].to_numpy()
            for at in range(0, len(a), 256):
                cosine = a[at : at + 256] @ b.T
                near = np.argpartition(-cosine, take - 1, axis=1)[:, :take]
                for i, js in enumerate(near):
                    exact = (b[js] * a[at + i]).sum(1)  # the same order of additions whatever the block
                    found = sorted((-s, int(v)) for s, j in zip(exact.tolist(), js) for v in ids[j])[: k + 1]
                    out["key"] += [keys_of[at + i]] * len(found)
                    out["id"] += [v for _, v in found]
                    out["score"] += [-s for s, _ in found]
        return pd.DataFrame(out).astype({"key": "int64", "id": "int64", "score": "float64"})

    cells = ["part", "qb", "cb"]
    hits = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInPandas(search, "key long, id long, score double")
    by_score = lambda *key: Window.partitionBy(*key).orderBy(F.col("score").desc(), "id")
    top = hits.withColumn("nth", F.row_number().over(by_score("key"))).filter(F.col("nth") <= k + 1)
    lists = top.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "score"))).alias("found")).join(asked, "key").select("h", "v", "found")
    # Queries with one vector share its list; each leaves out its own id.
    own = queries.select("id", "h", "v").distinct().join(lists, ["h", "v"])
    kept = F.slice(F.filter("found", lambda f: f["id"] != F.col("id")), 1, k)
    return own.select(F.col("id").alias("query_id"), F.posexplode(kept).alias("pos", "f")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("f.id").alias("vec_id"), F.col("f.score").alias("score"))
