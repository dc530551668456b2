"""Toxicity scores: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import labelled
from tickerloom.llm.common import doc_batches

BUCKETS_LOG = 16
#: N-grams of fewer training texts have no say, as nothing shared can be learned from them.
LEAST_TEXTS = 3
#: Averages of thousands of n-grams are small; the factor brings them to a scale that the softmax moves quickly. And the step size.
SCALE, RATE = 50, 0.03
GRAMS = (3, 4, 5, 6)
#: Bytes handled at once; longer texts are cut with enough overlap that no character n-gram is lost.
BLOCK = 1 << 20

_PART_OF_WORD = np.zeros(256, bool)
_PART_OF_WORD[0x80:] = True
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _PART_OF_WORD[_c] = True


def gram_buckets(text: bytes) -> Iterator[np.ndarray]:
    """Bucket numbers of all character n-grams of all words (with their boundaries), block by block; lower case."""
    low = text.decode("utf-8", "replace").lower().encode()
    for at in range(0, max(len(low), 1), BLOCK):
        raw = np.frombuffer(b" " + low[max(at - 1, 0) : at] + low[at : at + BLOCK + GRAMS[-1] - 1] + b" ", np.uint8)
        if at:
            raw = raw[1:]
        more = at + BLOCK < len(low)
        raw = raw[:-1] if more else raw
        inside = _PART_OF_WORD[raw]
        codes = np.where(inside, raw, np.uint8(0x20)).astype(np.uint32)
        # reach[i]: word bytes from i on, so that a window's interior can be tested at once
        breaks = np.flatnonzero(~inside)
        to_break = np.searchsorted(breaks, np.arange(len(raw)))
        ends = np.append(breaks, len(raw))[to_break]
        reach = (ends - np.arange(len(raw))).astype(np.int64)
        h = codes * np.uint32(0x01000193)
        for k in range(1, GRAMS[-1]):
            if k >= len(raw):
                break
            h = (h[:-1] ^ codes[k:]) * np.uint32(0x01000193) + np.uint32(k)
            n = k + 1
            if n not in GRAMS:
                continue
            # interior (1 .. n - 2) within one word; windows that start in the next block belong to it
            ok = reach[1 : len(h) + 1] >= n - 2
            last = min(len(h), BLOCK if more else len(h))
            chosen = h[:last][ok[:last]]
            yield (chosen * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS_LOG)


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams and their shares."""
    counts = np.zeros(1 << BUCKETS_LOG, np.int64)
    for buckets in gram_buckets(text):
        counts += np.bincount(buckets, minlength=len(counts))
    at = np.flatnonzero(counts)
    return at.astype(np.uint16), (counts[at] / max(counts.sum(), 1)).astype(np.float32)


@dataclass
class ToxicityModel:
    """Buckets' weights in the average (rare ones weigh more), their embeddings times the difference of the output vectors, and the bias."""

    rarity: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(*bag(text)), -40, 40))))

    def logit(self, at: np.ndarray, share: np.ndarray) -> float:
        part = self.rarity[at] * share
        total = part.sum(dtype=np.float64)
        return float(np.dot(self.weights[at], part) / total) + self.bias if total > 0 else self.bias


def rarity(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Logarithm of how few of these texts have a bucket; 0 for buckets of fewer than LEAST_TEXTS."""
    texts = np.zeros(1 << BUCKETS_LOG, np.int64)
    for at, _ in bags:
        texts[at] += 1
    return np.where(texts >= LEAST_TEXTS, np.log((1 + len(bags)) / (1 + texts)), 0).astype(np.float32)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dim: int = 8, epochs: int | None = None, seeds: tuple[int, ...] = (7, 8)) -> ToxicityModel:
    """Embeddings, output layer and bias by stochastic gradient steps on the softmax loss, text by text, with a falling step size.

    Both classes weigh alike. Steps of one size for all buckets let what many texts share grow first, so rare n-grams of single texts
    are not learned by heart. Models of several seeds are averaged (they are linear in a text's average).
    """
    rare, size = rarity(bags), 1 << BUCKETS_LOG
    parts = []
    for at, share in bags:
        part = rare[at] * share
        used = part > 0
        parts.append((at[used], (part[used] / max(part.sum(), 1e-12)).astype(np.float32)))
    epochs = epochs or int(np.clip(24_000 / max(len(y), 1), 6, 40))  # small samples need as many steps
    weight = np.where(y == 1, 0.5 / max((y == 1).mean(), 1e-9), 0.5 / max((y == 0).mean(), 1e-9)).astype(np.float32)
    weights, biases = np.zeros(size), []
    for seed in seeds:
        rng = np.random.default_rng(seed)
        emb = rng.normal(0, 0.1, (size, dim)).astype(np.float32)
        out = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
        bias = np.zeros(2, np.float32)
        for step, i in enumerate(np.concatenate([rng.permutation(len(y)) for _ in range(epochs)])):
            at, part = parts[i]
            hidden = emb[at].T @ part * SCALE
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= weight[i]
            back = out @ p * SCALE
            # A step never overshoots, however short the text or large the output vectors.
            steep = SCALE**2 * float(part @ part) * float((out * out).sum()) + float(hidden @ hidden)
            rate = RATE * (1 - step / (epochs * len(y))) / (1 + RATE * steep)
            emb[at] -= rate * part[:, None] * back
            out -= rate * np.outer(hidden, p)
            bias -= rate * p
        weights += emb @ (out[:, 1] - out[:, 0]) * SCALE / len(seeds)
        biases.append(float(bias[1] - bias[0]))
    return ToxicityModel(rare, weights.astype(np.float32), float(np.mean(biases)))


def threshold(logits: np.ndarray, y: np.ndarray, share: float) -> float:
    """The middle of the cut-offs with the fewest errors, if a share ``share`` of documents has label 1."""
    cost = np.where(y == 1, share / max((y == 1).sum(), 1), (1 - share) / max((y == 0).sum(), 1))
    order = np.argsort(logits)
    errors = np.concatenate([[0], np.cumsum(np.where(y[order] == 1, cost[order], -cost[order]))])  # all below the cut-off count as 0
    cuts = np.concatenate([[logits.min() - 1], (logits[order][1:] + logits[order][:-1]) / 2, [logits.max() + 1]])
    return float(np.median(cuts[errors <= errors.min() + 1e-12]))


def fit_calibrated(bags: list, y: np.ndarray, share: float, seed: int = 7) -> ToxicityModel:
    """Fit on two thirds, place the cut-off on the rest, then fit on everything."""
    part = np.random.default_rng(seed).permutation(len(y)) % 3
    rest, most = np.flatnonzero(part == 0), np.flatnonzero(part)
    shift = 0.0
    if len(set(y[rest].tolist())) == 2 and len(set(y[most].tolist())) == 2:
        trial = fit([bags[i] for i in most], y[most])
        # With few examples to place it on, the cut-off leans to equal costs: the rarer class would vanish otherwise.
        few = (y[rest] == 1).sum()
        shift = threshold(np.array([trial.logit(*bags[i]) for i in rest]), y[rest], (few * share + 100 * 0.3) / (few + 100))
    model = fit(bags, y)
    return ToxicityModel(model.rarity, model.weights, model.bias - shift)


def _views(column: pa.ChunkedArray, dtype) -> list[np.ndarray]:
    """Each value's bytes as numbers, where they lie: the driver holds the sample once."""
    out = []
    for chunk in column.chunks:
        ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        size = np.dtype(dtype).itemsize
        out += [np.frombuffer(chunk.buffers()[2], dtype, (b - a) // size, a) if b > a else np.zeros(0, dtype) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, fold_out: int = 0, most: int = 1500) -> ToxicityModel:
    """Fit on at most ``most`` labelled documents of each class (whole texts; bags are made on the executors)."""
    counts = labelled.class_counts(labels, label, folds, fold_out)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in doc_batches(batches):
            made = [bag(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), pa.array([a.tobytes() for a, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())], ["y", "at", "share"]
            )

    sample = labelled.training_sample(docs, labels, label, folds, fold_out, most)
    rows = sample.mapInArrow(bags, "y int, at binary, share binary").toArrow()
    order = pc.sort_indices(rows, sort_keys=[("y", "ascending"), ("at", "ascending")]).to_pylist()
    y = rows["y"].to_numpy().astype(np.int64)[order]
    if len(set(y.tolist())) < 2:  # nothing to tell apart: every document gets the one label's score
        return ToxicityModel(np.zeros(1 << BUCKETS_LOG, np.float32), np.zeros(1 << BUCKETS_LOG, np.float32), 40.0 if len(y) and y[0] else -40.0)
    at, share = _views(rows["at"], np.uint16), _views(rows["share"], np.float32)
    made = [(at[i], share[i]) for i in order]
    return fit_calibrated(made, y, counts.get(1, 0) / max(sum(counts.values()), 1))


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; null or empty texts score as an average of nothing: the bias alone.

    Repeated rows are scored each; null doc_id is kept; an empty table gives no rows; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in doc_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([model.score(t) for t in texts], pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def toxic_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, fold_out: int = 0, most: int = 1500) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.5) for every document, by a model trained on the other folds' labels."""
    scored = score_documents(docs, train(docs, labels, "toxic", folds, fold_out, most))
    return scored.select("doc_id", labelled.held_out(F.col("doc_id"), folds, fold_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_harmless(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs``, all columns, that score under 0.5; rows are filtered where they are, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in doc_batches(batches):
            yield batch.filter(pa.array([model.score(t) < 0.5 for t in texts]))

    return docs.mapInArrow(run, docs.schema)
