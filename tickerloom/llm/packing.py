"""Harmonic packing of documents into fixed-length token sequences."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tickerloom.llm.common import doc_batches
from tickerloom.llm.tokens import END_ID, default_vocabulary, encoder

#: Classes 1/1 to 1/CLASSES of the capacity; shorter documents belong to the last one.
CLASSES = 64
#: Tokens of cut documents that a task keeps for filling bins up, in sequences; tokens that go out in one record batch.
SPARE, BATCH_TOKENS = 64, 500_000

#: A piece is (doc_id, start, ids, doc_tokens).
Piece = tuple[int | None, int, np.ndarray, int]
_SCHEMA = pa.schema([(c, pa.binary() if c == "ids" else pa.int64()) for c in ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")])


class Packer:
    """The bins of one task.

    A document of n tokens, capacity / (k + 1) < n <= capacity / k, is of class k, and a bin of class k takes k documents whole:
    they fit whatever their lengths. What then is free in the bin is filled from cut documents: the rests of those longer than a
    sequence, and, only while none are left, the next document.
    """

    def __init__(self, capacity: int, first_sequence: int = 0, classes: int = CLASSES, spare: int = SPARE):
        self.capacity, self.sequence, self.classes, self.most_spare = capacity, first_sequence, min(classes, capacity), spare * capacity
        self.waiting: dict[int, list[Piece]] = {}
        self.spare: deque[Piece] = deque()
        self.n_spare = 0
        self.open: list[Piece] = []  # the bin that is being filled up, with ``room`` tokens free
        self.room = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at, n = 0, len(ids)
        while n - at >= self.capacity:
            self._place([(doc_id, at, ids[at : at + self.capacity], n)])
            at += self.capacity
        if at == n:
            return
        piece = (doc_id, at, ids[at:], n)
        if self.room or (at and self.n_spare < self.most_spare):
            self.spare.append(piece)
            self.n_spare += n - at
        else:
            k = min(self.capacity // (n - at), self.classes)
            self.waiting.setdefault(k, []).append(piece)
            if len(self.waiting[k]) == k:
                self.open = self.waiting.pop(k)
                self.room = self.capacity - sum(len(p[2]) for p in self.open)
        self._fill()

    def _fill(self) -> None:
        while self.room and self.spare:
            doc_id, start, ids, n = self.spare.popleft()
            if len(ids) > self.room:
                self.spare.appendleft((doc_id, start + self.room, ids[self.room :], n))
                ids = ids[: self.room]
            self.open.append((doc_id, start, ids, n))
            self.room -= len(ids)
            self.n_spare -= len(ids)
        if self.open and not self.room:
            self._place(self.open)
            self.open = []

    def finish(self) -> None:
        """Bins that did not fill (a few for each class) are joined and cut anew; the last sequences have the lengths of powers of two."""
        left = [*self.open, *self.spare, *(p for k in sorted(self.waiting) for p in self.waiting[k])]
        total = sum(len(p[2]) for p in left)
        rest = total % self.capacity
        sizes = [self.capacity] * (total // self.capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        self.open, self.spare, self.waiting = [], deque(left), {}
        for self.room in sizes:
            self._fill()

    def _place(self, pieces: list[Piece]) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), n, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def taken(self) -> pa.RecordBatch:
        """The rows made since the last call."""
        columns = list(zip(*self.rows)) or [()] * len(_SCHEMA)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = 2048, end_id: int = END_ID) -> DataFrame:
    """Pack whole documents, encoded and ended by ``end_id``, into sequences of at most ``capacity`` tokens.

    Every task packs its own documents (see Packer): no shuffle, and nothing is written in between. All sequences are full but for
    at most log2(capacity) a task, whose lengths are powers of two; nothing is padded. sequence_id is task * 2**32 + number.

    Returns one row a piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.
    Null or empty text: only ``end_id``. Very long texts: whole sequences and a rest. Null doc_id: kept as null. Repeated rows:
    packed once each. Documents of one length: in the order of the table. Empty table: no rows. Other columns of ``docs`` are left
    out, whatever their names.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    path = vocabulary or default_vocabulary()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held = Packer(capacity, TaskContext.get().partitionId() << 32), 0
        end = np.array([end_id], "<u4")
        for batch, texts in doc_batches(batches):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(path).each(texts)):
                packer.add(doc_id, np.append(ids, end))
                held += len(ids) + 1
                if held > BATCH_TOKENS:
                    yield packer.taken()
                    held = 0
        packer.finish()
        yield packer.taken()

    columns = ", ".join(f"{f.name} {'binary' if f.name == 'ids' else 'long'}" for f in _SCHEMA)
    return docs.select("doc_id", "text").mapInArrow(pack, columns)
