"""Shared storage, byte-level word hashing and Arrow helpers for the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}
_WRITTEN: dict[int, tuple[weakref.ref, str]] = {}
#: Rows whose texts a worker holds at once.
SLICE = 1_000
_KEPT: dict[str, object] = {}
_KEPT_FOR: list[int | None] = [None]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset: on a single machine a temporary folder,
    on a cluster one in the warehouse."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        single = spark.sparkContext.master.startswith("local")
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="tickerloom-") if single else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch-{app}"
        spark.sparkContext.setCheckpointDir(_OWN_DIR[app])
    return _OWN_DIR[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor costs a re-read only."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(back)] = (weakref.ref(back), path)
    return back


def discard(*written: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these, once their last reader is done."""
    for df in written:
        ref, path = _WRITTEN.pop(id(df), (None, None))
        if ref is not None and ref() is df:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of a text column; null counts as empty."""
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(column).cast(pa.large_binary())]


def kept_for_stage() -> dict[str, object]:
    """What this worker keeps from task to task of one stage; a task of another stage finds it empty."""
    context = TaskContext.get()
    stage = context.stageId() if context else None
    if _KEPT_FOR[0] != stage:
        _KEPT.clear()
        _KEPT_FOR[0] = stage
    return _KEPT


def release_freed() -> None:
    """Hand memory that is free back to the system: workers stay for later stages, which run beside them in the executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def doc_batches(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The rows in slices of at most SLICE, with their texts. What earlier stages left in this worker goes first, and what is free when the task ends."""
    kept_for_stage()
    release_freed()
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part, texts_of(part, column)
    release_freed()


# --- word hashes -------------------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(which: str, n: int) -> np.ndarray:
    """``_P ** i`` (or its inverse's powers) modulo 2**64 for i < n."""
    have = _POW[which]
    if len(have) < n:
        size = 1 << (n - 1).bit_length()
        have = np.full(size, _P if which == "up" else _P_INV, np.uint64)
        have[0] = 1
        have = _POW[which] = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte offsets of the words ``[^\\x20\\x09-\\x0D]+``."""
    word = np.empty(len(raw) + 2, dtype=np.int8)
    word[0] = word[-1] = 0
    np.logical_not(_SPACE[raw], out=word[1:-1].view(bool))
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each A-Z-lower-cased word: polynomial prefix sums modulo 2**64, so no Python loop over words."""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    start, end = word_bounds(raw)
    if not len(start):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * _powers("up", len(raw)), out=total[1:])
    return mix((total[end] - total[start]) * _powers("down", len(raw))[start] + (end - start).astype(np.uint64))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; with fewer words, one hash of the whole sequence; without words, none."""
    if not len(words):
        return words
    width_here = min(width, len(words))
    n = len(words) - width_here + 1
    h = np.full(n, width_here, np.uint64)
    for k in range(width_here):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n])
    return h
