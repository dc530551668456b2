"""Quality scores: similarity-weighted votes of labelled neighbours in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm import labelled
from tickerloom.llm.common import doc_batches, word_hashes

#: Terms: hashed words, hashed trigrams of character classes, shares of repeated words, lengths.
WORDS, GRAMS, REPEATS, LENGTHS = 512, 512, 4, 16
TERMS = WORDS + GRAMS + REPEATS + LENGTHS
#: What the words weigh beside the trigrams.
WORD_WEIGHT = 1.0
BLOCK = 1 << 22

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x80:] = ord("a")
for _c in b"abcdefghijklmnopqrstuvwxyz":
    _CLASS[_c] = ord("a")
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _CLASS[_c] = ord("A")
for _c in b"0123456789":
    _CLASS[_c] = ord("0")


def terms(text: bytes) -> np.ndarray:
    """Term weights of a whole text: its words, what kinds of characters follow each other, how words repeat, how long it is."""
    of_word, grams, repeats, lengths = np.zeros(WORDS), np.zeros(GRAMS), np.zeros(REPEATS), np.zeros(LENGTHS)
    for at in range(0, len(text), BLOCK):
        c = _CLASS[np.frombuffer(text[max(at - 2, 0) : at + BLOCK], np.uint8)].astype(np.uint32)
        if len(c) > 2:
            h = ((c[:-2] * np.uint32(961) + c[1:-1] * np.uint32(31) + c[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(23)
            grams += np.bincount(h, minlength=GRAMS)
    words = word_hashes(text)
    if len(words):
        of_word += np.bincount((words >> np.uint64(55)).astype(np.int64), minlength=WORDS)
    if len(words) > 1:
        same = words[1:] == words[:-1]
        repeats[0] = same.mean() ** 0.5
        repeats[1] = (1 - len(np.unique(words)) / len(words)) / 2
        repeats[2] = 0.5 * same.any()
    repeats[3] = 0.3
    lengths[min(LENGTHS - 1, len(words).bit_length())] = 0.25
    share = lambda counts: np.sqrt(counts / max(counts.sum(), 1))
    return np.concatenate([WORD_WEIGHT * share(of_word), share(grams), repeats, lengths])


@dataclass
class NeighbourVote:
    """Projection to the latent space, the labelled vectors there (unit length), and their labels' weights."""

    scale: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray
    weights: np.ndarray
    neighbours: int = 24
    sharpness: float = 24.0

    def embed(self, rows: np.ndarray) -> np.ndarray:
        low = (rows * self.scale) @ self.axes
        return low / np.maximum(np.linalg.norm(low, axis=1, keepdims=True), 1e-12)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if len(self.vectors) == 0:
            return np.full(len(rows), 0.5)
        cosine = self.embed(rows) @ self.vectors.T
        k = min(self.neighbours, len(self.vectors))
        at = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(cosine, at, 1)
        w = np.exp(self.sharpness * (near - near.max(1, keepdims=True))) * self.weights[at]
        return (w * self.votes[at]).sum(1) / w.sum(1)


def fit(rows: np.ndarray, y: np.ndarray, share: float, dim: int = 64) -> NeighbourVote:
    """Latent-semantic axes of the labelled rows (from their Gram matrix), weighted by how few rows hold a term."""
    if not len(y):
        return NeighbourVote(np.ones(TERMS), np.zeros((TERMS, 1)), np.zeros((0, 1)), np.zeros(0), np.zeros(0))
    scale = 1 + np.log((1 + len(y)) / (1 + (rows > 0).sum(0)))
    scaled = rows * scale
    values, axes = np.linalg.eigh(scaled.T @ scaled)
    axes = axes[:, np.argsort(-values)[:dim]]
    low = scaled @ axes
    low /= np.maximum(np.linalg.norm(low, axis=1, keepdims=True), 1e-12)
    shares = {1: share, 0: 1 - share}
    weights = np.array([shares[int(v)] / max((y == v).mean(), 1e-9) for v in y])
    return NeighbourVote(scale, axes, low, y.astype(float), weights)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, fold_out: int = 1, most: int = 2000) -> NeighbourVote:
    """Place at most ``most`` labelled documents of each class in the latent space; their terms are made on the executors."""
    counts = labelled.class_counts(labels, label, folds, fold_out)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in doc_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([terms(t).astype(np.float32).tobytes() for t in texts], pa.binary())], ["y", "terms"])

    sample = labelled.training_sample(docs, labels, label, folds, fold_out, most)
    rows = sample.mapInArrow(rows_of, "y int, terms binary").toArrow().sort_by([("y", "ascending"), ("terms", "ascending")])
    y = rows["y"].to_numpy().astype(np.int64)
    made = np.array([np.frombuffer(t, np.float32) for t in rows["terms"].to_pylist()], np.float64).reshape(len(y), TERMS)
    return fit(made, y, counts.get(1, 0) / max(sum(counts.values()), 1))


def score_documents(docs: DataFrame, model: NeighbourVote, block: int = 256) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text: all cosines to the labelled vectors, in blocks of ``block`` documents.

    Null or empty texts have the terms of an empty text; without labels every score is 0.5. Repeated rows are scored each;
    null doc_id is kept; an empty table gives no rows; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in doc_batches(batches):
            scores = [shared.value.score(np.array([terms(t) for t in texts[i : i + block]])) for i in range(0, len(texts), block)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.concatenate(scores), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def quality_documents(docs: DataFrame, labels: DataFrame, folds: int = 3, fold_out: int = 1, most: int = 2000) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.5) for every document, by votes of the other folds' labels."""
    scored = score_documents(docs, train(docs, labels, "quality", folds, fold_out, most))
    return scored.select("doc_id", labelled.held_out(F.col("doc_id"), folds, fold_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
