"""What Python workers hold: slices of a batch, few words in the library at once, nothing of another stage."""

import pyarrow as pa

from tickerloom.llm import common, tokens
from tickerloom.llm.tokens import WordEncoder, default_vocabulary, encoder


def test_batches_come_in_slices():
    n = 2 * common.SLICE + 7
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(n)), "text": [None if k % 5 == 0 else f"é{k}" for k in range(n)]})
    parts = list(common.doc_batches(iter([batch, batch.slice(0, 0)])))
    assert max(len(texts) for _, texts in parts) <= common.SLICE
    assert [(i, t) for part, texts in parts for i, t in zip(part.column("doc_id").to_pylist(), texts, strict=True)] == [(k, b"" if k % 5 == 0 else f"é{k}".encode()) for k in range(n)]


def test_new_words_are_learned_some_at_a_time(monkeypatch):
    whole, e, sizes = WordEncoder(default_vocabulary()), WordEncoder(default_vocabulary()), []
    texts = [" ".join(f"{w}{chr(97 + k % 26)}{chr(97 + k // 26)}" for w in ("word", "Ωmega-", "<|x|>")).encode() for k in range(60)]
    want = [x.tolist() for x in whole.each(texts)]
    monkeypatch.setattr(tokens, "LEARN", 7, raising=False)
    learn = WordEncoder._learn_some
    monkeypatch.setattr(WordEncoder, "_learn_some", lambda self, new: (sizes.append(len(new)), learn(self, new)))
    assert [x.tolist() for x in e.each(texts)] == want
    assert len(sizes) > 1 and max(sizes) <= 7 and sum(sizes) == len(e)


def test_a_later_stage_finds_no_encoder(spark):
    rows = spark.createDataFrame([(k, f"word{k}") for k in range(40)], "doc_id long, text string").repartition(4)

    def encode(batches):
        for batch, texts in common.doc_batches(batches):
            yield pa.RecordBatch.from_pydict({"n": [sum(map(len, encoder(default_vocabulary()).each(texts)))]})

    def held(batches):
        import gc

        for _ in common.doc_batches(batches):
            yield pa.RecordBatch.from_pydict({"n": [sum(isinstance(x, WordEncoder) for x in gc.get_objects())]})

    assert sum(r.n for r in rows.mapInArrow(encode, "n long").collect()) > 40
    assert {r.n for r in rows.mapInArrow(held, "n long").collect()} == {0}
