"""Embedding whitening from an exact integer scatter.

Vectors become integers; their sums and cross-products are accumulated without rounding, so the covariance is exact until it is
turned into doubles once, for the eigen-decomposition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import discard, materialize

#: Steps a unit of a component is cut into.
SCALE = 256
#: Components returned at most.
COMPONENTS = 4
#: Bits of a limb and rows of a block: a product of limbs summed over a block stays below 2**53, so doubles hold it exactly.
LIMB_BITS, BLOCK_ROWS = 20, 4096

LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def usable(e: Column) -> Column:
    """Whether a vector is there, has entries, and all of them are finite numbers."""
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return e.isNotNull() & (F.size(e) > 0) & F.coalesce(fine, F.lit(False))


def to_integers(x: np.ndarray) -> np.ndarray:
    """floor(256 * c) of each entry; beyond the range of a long, its nearest end."""
    with np.errstate(over="ignore"):
        y = np.floor(SCALE * x)
    out = np.where(np.abs(y) < 2.0**63, y, 0).astype(np.int64)
    out[y >= 2.0**63] = HIGH
    out[y <= -(2.0**63)] = LOW
    return out


def packed(x: np.ndarray) -> bytes:
    """An integer vector in the narrowest of four widths that holds it: equal vectors, and they only, have equal bytes."""
    low, high = int(x.min()), int(x.max())
    for code in "bhiq":
        info = np.iinfo(f"<i{np.dtype(code).itemsize}")
        if info.min <= low and high <= info.max:
            return np.dtype(code).itemsize.to_bytes(1, "little") + x.astype(f"<i{np.dtype(code).itemsize}").tobytes()
    raise AssertionError("a long holds every entry")


def unpacked(column: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(raw, f"<i{raw[0]}", offset=1).astype(np.int64) for raw in column.to_pylist()])


def limbs(x: np.ndarray, shift: np.ndarray) -> list[np.ndarray]:
    """x - shift as a sum of limb[k] * 2**(LIMB_BITS * k), each limb a double of at most LIMB_BITS bits; usually one limb."""
    far = max(int(x.max()) - int(shift.min()), int(shift.max()) - int(x.min()))
    rest = x - shift if far < 2**62 else x.astype(object) - shift.astype(object)
    out, bits = [], LIMB_BITS - 1
    while True:
        low = ((rest + (1 << bits)) & ((1 << LIMB_BITS) - 1)) - (1 << bits)
        out.append(low.astype(np.float64))
        rest = (rest - low) >> LIMB_BITS
        if not rest.any():
            return out


class Scatter:
    """Count, sums and cross-products of integer vectors about a shift, as integers of any size."""

    def __init__(self, shift: np.ndarray):
        dim = len(shift)
        self.shift, self.n = shift, 0
        self.sums, self.products = np.zeros(dim, object), np.zeros((dim, dim), object)

    def add(self, x: np.ndarray) -> None:
        for at in range(0, len(x), BLOCK_ROWS):
            parts = limbs(x[at : at + BLOCK_ROWS], self.shift)
            self.n += len(parts[0])
            for i, a in enumerate(parts):
                self.sums += a.sum(0).astype(np.int64).astype(object) * (1 << LIMB_BITS * i)
                for j, b in enumerate(parts):
                    self.products += (a.T @ b).astype(np.int64).astype(object) * (1 << LIMB_BITS * (i + j))


@dataclass
class Whitener:
    """Fitted components: rows of ``axes`` are unit eigenvectors; ``values`` their eigenvalues, zero where the data have no spread."""

    n: int
    sums: np.ndarray  # of Python integers
    axes: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: longs where they suffice, else Python integers."""
        most = max(abs(int(x.max())), abs(int(x.min()))) * self.n + max(abs(int(s)) for s in self.sums)
        return x * self.n - self.sums.astype(np.int64) if most < 2**62 else x.astype(object) * self.n - self.sums

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened coordinates; NaN along components without spread."""
        if centred.dtype == object:  # one rounding, as the quotient of two integers
            y = np.array([[int(v) / self.n for v in row] for row in centred]).reshape(centred.shape)
        else:
            y = centred / self.n
        spread = np.sqrt(np.where(self.values > 0, self.values, np.nan))
        return (y @ self.axes.T) / spread


def decompose(n: int, sums: np.ndarray, scatter: np.ndarray) -> Whitener:
    """From n * XᵀX - SSᵀ in integers: each entry becomes a double by one division, then eigh."""
    square = n * n
    v = np.array([[int(c) / square for c in row] for row in scatter])
    values, vectors = np.linalg.eigh(v)
    take = np.argsort(-values, kind="stable")[:COMPONENTS]
    values, axes = values[take], vectors[:, take].T.copy()
    for a in axes:  # one of the two signs: the largest entry is positive
        if a[np.argmax(np.abs(a))] < 0:
            a *= -1
    trace = float(sum(int(scatter[i, i]) for i in range(len(v))) / square)
    noise = len(v) * np.finfo(float).eps * max(float(values[0]), 0.0)
    return Whitener(n, sums, axes, np.where(values > noise, values, 0.0), trace)


def _integers_of(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if len(column) else pa.array([], pa.float64())
    return to_integers(flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))


def _partial_scatters(fit: DataFrame, shift: np.ndarray) -> DataFrame:
    """(i, n, values): row i of a task's cross-products, and as row -1 its sums, as decimal texts of integers of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Scatter(shift)
        for batch in batches:
            if batch.num_rows:
                total.add(unpacked(batch.column("x")))
        if total.n:
            rows = [total.sums, *total.products]
            texts = pa.array([[str(int(v)) for v in r] for r in rows], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(rows) - 1), pa.int32()), pa.array([total.n] * len(rows), pa.int64()), texts], ["i", "n", "values"])

    return fit.select("x").mapInArrow(run, "i int, n long, values array<string>")


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(len(pdf["values"].iloc[0]), object)
    for values in pdf["values"]:
        total += np.array([int(v) for v in values], object)
    return pd.DataFrame({"i": [pdf["i"].iloc[0]], "n": [pdf["n"].sum()], "values": [[str(v) for v in total]]})


def fit_whitener(fit: DataFrame, dim: int) -> Whitener | None:
    """Fit on a table of distinct packed vectors (column x). Tasks send dim + 1 rows each, which are added up by row; only the
    dim x dim totals reach the driver. None without vectors."""
    first = fit.select("x").head(1)
    if not first:
        return None
    # Any shift gives the same covariance; a vector of the table keeps the numbers small.
    shift = unpacked(pa.array([bytes(first[0]["x"])], pa.binary()))[0]
    partial = _partial_scatters(fit, shift)
    rows = partial.groupBy("i").applyInPandas(_added, "i int, n long, values array<string>").collect()
    of = {r["i"]: [int(v) for v in r["values"]] for r in rows}
    n, about = int(rows[0]["n"]), np.array(of[-1], object)
    products = np.array([of[i] for i in range(dim)], object)
    scatter = n * products - np.outer(about, about)
    return decompose(n, about + n * shift.astype(object), scatter)


def measure_identity(fit: DataFrame, model: Whitener) -> float | None:
    """The largest entry of |covariance of the whitened fit list - identity|: block by block, centred before multiplying."""
    k = np.flatnonzero(model.values > 0)
    if not len(k):
        return None
    shared = fit.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                x = unpacked(batch.column("x").slice(at, BLOCK_ROWS))
                w = shared.value.project(shared.value.centred(x))[:, k]
                mean = w.mean(0)
                columns = [pa.array([len(w)], pa.int64()), pa.array([mean.tolist()]), pa.array([((w - mean).T @ (w - mean)).ravel().tolist()])]
                yield pa.RecordBatch.from_arrays(columns, ["n", "mean", "scatter"])

    blocks = fit.select("x").mapInArrow(run, "n long, mean array<double>, scatter array<double>")
    at = lambda c, i: F.col(c)[i]
    n = F.sum("n")
    means = blocks.agg(n.alias("n"), *[(F.sum(F.col("n") * at("mean", i)) / n).alias(f"m{i}") for i in range(len(k))]).first()
    away = [at("mean", i) - F.lit(means[f"m{i}"]) for i in range(len(k))]
    entries = blocks.agg(*[(F.sum(at("scatter", i * len(k) + j) + F.col("n") * away[i] * away[j]) / F.lit(means["n"])).alias(f"c{i}_{j}") for i in range(len(k)) for j in range(len(k))]).first()
    return max(abs(entries[f"c{i}_{j}"] - (i == j)) for i in range(len(k)) for j in range(len(k)))


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, component (from 1, at most COMPONENTS), n, deviation, whitened, explained, identity_error, deviation_text of every usable row.

    Entries become x = floor(256 * c) (beyond a long: its nearest end). The fit list holds each distinct x vector once, n in all with
    sums S; components are unit eigenvectors of its covariance by falling eigenvalue, their largest entry positive. deviation is
    the exact sum of (n * x - S)**2, null where a long cannot hold it; deviation_text holds it always.

    Left out: vectors that are null, empty, hold null or non-finite entries, or have another length than the most common one
    (of several, the largest). Repeated rows and a null vec_id: a result each. Copies count once in the fit, so a vector that a
    third of the rows share weighs no more than others and is combined before the shuffle. Equal eigenvalues: any basis of
    their space. A component without spread (n = 1, or fewer independent directions than components): whitened null, explained 0,
    null if nothing varies at all; identity_error is over the others, null without any. Empty table: no rows. Other columns are
    left out, whatever their names.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("v")).filter(usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], SCHEMA)
    dim = lengths[0]["n"]
    rows = rows.filter(F.size("v") == dim)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([packed(x) for x in _integers_of(batch.column("v"), dim)], pa.binary())], ["x"])

    fit = materialize(rows.select("v").mapInArrow(pack, "x binary").distinct(), "fit-list")
    model = fit_whitener(fit, dim)
    model.identity_error = measure_identity(fit, model)
    discard(fit)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.values)
        explained = [float(e) / m.trace if m.trace > 0 else None for e in m.values]
        for batch in batches:
            if not batch.num_rows:
                continue
            centred = m.centred(_integers_of(batch.column("v"), dim))
            w = m.project(centred)
            if centred.dtype == object or int(np.abs(centred).max()) ** 2 * dim > HIGH:
                exact = [sum(int(v) ** 2 for v in row) for row in centred]
            else:
                exact = (centred * centred).sum(1).tolist()
            row, flat = np.repeat(np.arange(len(w)), k), w.ravel()
            columns = [
                batch.column("vec_id").take(pa.array(row)),
                pa.array(np.tile(np.arange(1, k + 1), len(w)), pa.int32()),
                pa.array([m.n] * len(row), pa.int64()),
                pa.array([d if d <= HIGH else None for d in exact], pa.int64()).take(pa.array(row)),
                pa.array(flat, pa.float64(), mask=np.isnan(flat)),
                pa.array(explained * len(w), pa.float64()),
                pa.array([m.identity_error] * len(row), pa.float64()),
                pa.array([str(d) for d in exact]).take(pa.array(row)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)
