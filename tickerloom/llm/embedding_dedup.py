"""Near duplicates among embeddings by an inverted multi-index.

Codebooks for the two halves of a unit vector are fitted independently; their product is a grid of cells. Every vector lies in
one cell and visits the nearest ones in the order of their summed distances, as many as a target recall takes; there
cosines in double precision decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import discard, materialize
from tickerloom.llm.jaccard_join import components
from tickerloom.llm.neighbours import _usable

COSINE = 0.9
#: Share of pairs at the least linking cosine that the visited cells must find.
RECALL = 0.98
#: Vectors that codebooks are fitted on at most, codes of a half at most, and vectors of a cell aimed at.
SAMPLE, MOST_CODES, CELL_VECTORS = 20_000, 256, 8
#: Vectors whose traversal is measured, for each of two kinds of pairs.
PROBES = 1500
#: Neighbouring cells form segments of at least and at most so many residents, SEGMENTS in number between these; a larger cell is dealt out in
#: blocks. Visitors of a segment are dealt out likewise.
LEAST_RESIDENTS, MOST_RESIDENTS, SEGMENTS, LEAST_VISITORS, MOST_VISITORS = 128, 8192, 256, 1024, 8192


def codebook(x: np.ndarray, codes: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Centres of ``codes`` groups of rows; a group without rows keeps its centre."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:codes]].copy()
    for _ in range(rounds):
        of = np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, 1)
        size = np.bincount(of, minlength=codes)
        total = np.zeros_like(centres)
        np.add.at(total, of, x)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


@dataclass
class MultiIndex:
    """Codebooks of both halves and the number of cells that each vector visits."""

    first: np.ndarray
    second: np.ndarray
    visits: int = 1

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to the codes of either half, but for the vector's own length."""
        cut = self.first.shape[1]
        of = lambda x, c: (c * c).sum(1) - 2 * x @ c.T
        return of(unit[:, :cut], self.first), of(unit[:, cut:], self.second)

    def traverse(self, unit: np.ndarray, visits: int | None = None) -> np.ndarray:
        """The nearest cells of each row as numbers, nearest first, ties to the smaller place in both orders.

        In the multi-sequence order the cell (i, j) of the two sorted lists comes after all (i', j') below it, so the first n cells
        lie among those with (i + 1) * (j + 1) <= n: these are all that is summed and sorted, for many vectors at once.
        """
        n = min(visits or self.visits, len(self.first) * len(self.second))
        a, b = self.distances(unit)
        near_a, near_b = np.argsort(a, 1, kind="stable")[:, :n], np.argsort(b, 1, kind="stable")[:, :n]
        i, j = np.divmod(np.arange(near_a.shape[1] * near_b.shape[1]), near_b.shape[1])
        i, j = i[(below := (i + 1) * (j + 1) <= n)], j[below]
        summed = np.take_along_axis(a, near_a, 1)[:, i] + np.take_along_axis(b, near_b, 1)[:, j]
        order = np.argsort(summed, 1, kind="stable")[:, :n]
        return near_a[np.arange(len(a))[:, None], i[order]] * len(self.second) + near_b[np.arange(len(a))[:, None], j[order]]


def fit_index(x: np.ndarray, rows: int, cosine: float = COSINE, recall: float = RECALL, seed: int = 7) -> MultiIndex:
    """Codebooks on a sample of unit vectors for a table of ``rows``; visits measured on pairs.

    Measured are pairs of the sample and pairs made by turning sampled vectors in random directions to the least linking
    cosine, the hardest to find. A pair counts as found if either vector visits the other's cell. The larger need decides.
    """
    rng = np.random.default_rng(seed)
    codes = int(np.clip(2 ** np.ceil(np.log2(max(rows / CELL_VECTORS, 1)) / 2), 1, min(MOST_CODES, len(x))))
    cut = x.shape[1] // 2
    index = MultiIndex(codebook(x[:, :cut], codes), codebook(x[:, cut:], codes, seed=6))
    some = x[rng.permutation(len(x))[:PROBES]]
    away = rng.normal(size=some.shape)
    away -= (away * some).sum(1, keepdims=True) * some
    length = np.sqrt((away * away).sum(1, keepdims=True))
    turned = cosine * some + np.sqrt(max(0.0, 1 - cosine * cosine)) * away / np.where(length > 0, length, 1)
    pairs = [(some, turned)]
    near = some @ x.T
    a, b = np.nonzero((near >= cosine) & (near < 1 - 1e-12))
    if len(a):
        take = rng.permutation(len(a))[:PROBES]
        pairs.append((some[a[take]], x[b[take]]))
    for u, v in pairs:
        needed = np.minimum(_places(index, u, v), _places(index, v, u))
        index.visits = max(index.visits, int(np.quantile(needed, recall, method="higher")) + 1)
    return index


def _places(index: MultiIndex, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """How many cells each u would visit before the one that its v lies in."""
    out = []
    for at in range(0, len(u), 256):
        a, b = index.distances(u[at : at + 256])
        i, j = (d.argmin(1) for d in index.distances(v[at : at + 256]))
        k = np.arange(len(a))
        target = a[k, i] + b[k, j]
        out.append((a[:, :, None] + b[:, None, :] < target[:, None, None]).sum((1, 2)))
    return np.concatenate(out)


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(1, keepdims=True)  # squares of tiny or huge numbers would leave the range
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _units(raw: list[bytes], dtype: str, dim: int) -> np.ndarray:
    return _unit(np.frombuffer(b"".join(raw), dtype).astype(np.float64).reshape(-1, dim))


def _forest(labels: np.ndarray, linked: np.ndarray) -> tuple[list[int], list[int]]:
    """Of the links between visitors (rows) and residents (columns), as few as join what they join; labels: residents' so far."""
    left, right = [], []
    for v in np.flatnonzero(linked.any(1)):
        at = np.flatnonzero(linked[v])
        seen, first = np.unique(labels[at], return_index=True)
        for other in seen[1:]:
            labels[labels == other] = seen[0]
        left += [int(v)] * len(seen)
        right += at[first].tolist()
    return left, right


BLOCK = "node long, links long, a long, b long"


def compare_block(visitors: pd.DataFrame, residents: pd.DataFrame, dtype: str, dim: int, cosine: float) -> pd.DataFrame:
    """Link counts (node, links) of visitors (node, n, vec, home, cells: those visited here) and residents (likewise; cells: all that
    they visit), and a spanning forest (a, b) of the links found. n: rows of a vector.

    A pair is counted for the visitor; for the resident too, unless it visits the visitor's cell and so counts the pair there.
    """
    nodes, links, edges = [], [], ([], [])
    if len(visitors) and len(residents):
        u, v = (_units(list(f["vec"]), dtype, dim) for f in (visitors, residents))
        (node_u, n_u, home_u), (node_v, n_v, home_v) = ((f["node"].to_numpy(), f["n"].to_numpy(), f["home"].to_numpy()) for f in (visitors, residents))
        counts_u, counts_v = np.zeros(len(u), np.int64), np.zeros(len(v), np.int64)
        of_visit, visits = np.repeat(np.arange(len(u)), [len(c) for c in visitors["cells"]]), np.concatenate(list(visitors["cells"]))
        order = np.argsort(visits, kind="stable")
        cells, starts = np.unique(visits[order], return_index=True)
        for cell, coming in zip(cells, np.split(of_visit[order], starts[1:])):
            here = np.flatnonzero(home_v == cell)
            if not len(here):
                continue
            labels = np.arange(len(here))
            goes = residents["cells"].iloc[here]
            of_goes, all_goes = np.repeat(np.arange(len(here)), [len(c) for c in goes]), np.concatenate(list(goes))
            for at in range(0, len(coming), 512):
                who = coming[at : at + 512]
                linked = (u[who] @ v[here].T >= cosine) & (node_u[who][:, None] != node_v[here][None, :])
                some = linked.any(1)
                if not some.any():
                    continue
                who, linked = who[some], linked[some]
                counts_u[who] += linked @ n_v[here]
                for home in np.unique(home_u[who]):
                    back = np.zeros(len(here), bool)
                    back[of_goes[all_goes == home]] = True
                    of_home = home_u[who] == home
                    counts_v[here] += np.where(back, 0, n_u[who[of_home]] @ linked[of_home])
                a, b = _forest(labels, linked)
                edges[0].extend(node_u[who][a].tolist())
                edges[1].extend(node_v[here][b].tolist())
        nodes, links = np.concatenate([node_u[counts_u > 0], node_v[counts_v > 0]]).tolist(), np.concatenate([counts_u[counts_u > 0], counts_v[counts_v > 0]]).tolist()
    none, gap = [None] * len(edges[0]), [None] * len(nodes)
    columns = {"node": nodes + none, "links": links + none, "a": gap + edges[0], "b": gap + edges[1]}
    return pd.DataFrame({c: pd.array(x, "Int64") for c, x in columns.items()})


@dataclass
class Dealing:
    """Which segment a cell belongs to, and into how many blocks residents and visitors of each segment are dealt."""

    segment: np.ndarray
    resident_blocks: np.ndarray
    visitor_blocks: np.ndarray | None = None


def deal_cells(residents: np.ndarray) -> Dealing:
    """Cells in their order, cut where a segment is full; a cell that fills one alone is cut into blocks."""
    most = int(np.clip(residents.sum() // SEGMENTS, LEAST_RESIDENTS, MOST_RESIDENTS))
    segment, total, at = np.zeros(len(residents), np.int64), [0], 0
    for cell, n in enumerate(residents):
        if total[at] and total[at] + n > most:
            at += 1
            total.append(0)
        segment[cell] = at
        total[at] += int(n)
    return Dealing(segment, np.maximum(1, -(-np.array(total) // most)))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Two rows link if their vectors' cosine is at least ``cosine`` and one visits the other's cell: nothing below it links, and
    about ``recall`` of the pairs at it, more of nearer ones. n_links counts other rows linked; component_id is the smallest
    vec_id reachable; kept says whether that is the row's own.

    Equal vectors are one class, combined before the shuffle and compared once; they link with one another. The index is fitted on at
    most SAMPLE classes, chosen by hash, and holds all. Large cells are dealt out in blocks; of the links found in a block, counts
    and a spanning forest leave it. Null, empty, zero and non-finite vectors, vectors of another length than the most common (of
    several, the largest) and rows with a null vec_id link with nothing: n_links 0, component their own vec_id. Repeated rows are rows of
    their own, linked by cosine 1; one vec_id with several vectors: each row has its own links. Ties in distance go to the smaller
    code. Empty table: no rows. Other columns are left out, whatever their names.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v"))
    fine = rows.filter(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    lengths = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).limit(1).collect()
    alone = lambda df: df.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    if not lengths:
        return alone(rows)
    dim = lengths[0]["n"]
    takes_part = F.coalesce(F.col("vec_id").isNotNull() & _usable(F.col("v")) & (F.size("v") == dim), F.lit(False))
    dtype = "<f4" if vectors.schema[vector_column].dataType.elementType.simpleString() == "float" else "<f8"

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, dim) + np.zeros(1, dtype)  # -0.0 becomes 0.0
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "vec"])

    members = rows.filter(takes_part).mapInArrow(raw, "vec_id long, vec binary")
    grouped = members.groupBy("vec").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("rep"))
    classes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    n_classes = classes.count()
    sample = classes.orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).select("vec").toArrow()["vec"].to_pylist()
    index = spark.sparkContext.broadcast(fit_index(_units(sample, dtype, dim), n_classes, cosine, recall))
    n_cells = len(index.value.first) * len(index.value.second)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                cells = index.value.traverse(_units(part.column("vec").to_pylist(), dtype, dim))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "n", "vec")), pa.array(cells[:, 0], pa.int32()), pa.array(list(cells), pa.list_(pa.int32()))], ["node", "n", "vec", "home", "cells"])

    placed = materialize(classes.select("node", "n", "vec").mapInArrow(place, "node long, n long, vec binary, home int, cells array<int>"), "placed")
    # A few numbers for each cell, of which there are at most MOST_CODES**2.
    sizes = np.zeros(n_cells, np.int64)
    for r in placed.groupBy("home").count().collect():
        sizes[r["home"]] = r["count"]
    dealing = deal_cells(sizes)
    segment_of = spark.sparkContext.broadcast(dealing.segment)

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(int(segment_of.value.max()) + 1, np.int64)
        for batch in batches:
            for cells in batch.column("cells").to_pylist():
                total[np.unique(segment_of.value[cells])] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["segment", "n"])

    coming = np.zeros(len(dealing.resident_blocks), np.int64)
    for r in placed.select("cells").mapInArrow(visited, "segment long, n long").groupBy("segment").agg(F.sum("n").alias("n")).collect():
        coming[r["segment"]] = r["n"]
    most = int(np.clip(1.25 * coming.mean(), LEAST_VISITORS, MOST_VISITORS))
    dealing.visitor_blocks = np.maximum(1, -(-coming // most))
    deal = spark.sparkContext.broadcast(dealing)
    key, schema = ["segment", "rb", "vb"], "segment long, rb int, vb int, node long, n long, vec binary, home int, cells array<int>"

    def dealt(batches: Iterator[pa.RecordBatch], visitors: bool) -> Iterator[pa.RecordBatch]:
        d = deal.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                places, lists = [], []
                for at, (node, home, cells) in enumerate(zip(*(part.column(c).to_pylist() for c in ("node", "home", "cells")))):
                    cells = np.array(cells, np.int32)
                    to = d.segment[cells] if visitors else d.segment[[home]]
                    for s in np.unique(to):
                        here = cells[to == s] if visitors else cells
                        rbs, vbs = int(d.resident_blocks[s]), int(d.visitor_blocks[s])
                        mixed = node * 0x9E3779B97F4A7C15 % 2**64 >> 20
                        for rb, vb in ((rb, mixed % vbs) for rb in range(rbs)) if visitors else ((mixed % rbs, vb) for vb in range(vbs)):
                            places.append((at, s, rb, vb))
                            lists.append(here)
                if places:
                    at, s, rb, vb = (np.array(c, np.int64) for c in zip(*places))
                    columns = [pa.array(s), pa.array(rb, pa.int32()), pa.array(vb, pa.int32()), *(part.column(c).take(pa.array(at)) for c in ("node", "n", "vec", "home")), pa.array(lists, pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, [*key, "node", "n", "vec", "home", "cells"])

    left, right = (placed.mapInArrow(lambda b, v=v: dealt(b, v), schema) for v in (True, False))
    compare = lambda u, v: compare_block(u, v, dtype, dim, cosine)
    found = materialize(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(compare, BLOCK), "compared")

    counts = found.filter(F.col("node").isNotNull()).groupBy("node").agg(F.sum("links").alias("links"))
    named = lambda c: classes.select(F.col("node").alias(c), F.struct("rep", "node").alias(f"{c}_named"))
    edges = found.filter(F.col("a").isNotNull()).select("a", "b").distinct().join(named("a"), "a").join(named("b"), "b")
    label = components(edges.select(F.col("a_named").alias("a"), F.col("b_named").alias("b")))
    of_class = label.select(F.col("node.node").alias("node"), F.col("label.rep").alias("component"))
    key_of = F.unhex(F.sha2("vec", 256)).alias("key")
    solved = classes.select("node", key_of, "n", "rep").join(counts, "node", "left").join(of_class, "node", "left")
    solved = solved.select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = members.select("vec_id", key_of).join(solved, "key").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    result = materialize(linked.unionByName(alone(rows.filter(~takes_part))), "near-duplicates")
    discard(classes, placed, found)
    return result
