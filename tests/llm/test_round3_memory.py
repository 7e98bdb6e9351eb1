"""What a Python task of the pipeline holds at one time follows from bytes of text, not from numbers of documents."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from tomolake.llm import common, pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture
def encode(spark, monkeypatch):
    """The function that a task of the encoder runs, and the sizes of the texts that it takes together."""
    taken, plain = [], pieces.PieceModel.encode
    monkeypatch.setattr(pieces.PieceModel, "encode", lambda self, texts: taken.append([len(t.encode()) for t in texts]) or plain(self, texts))
    docs = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, fn, schema: fn)
    return pieces.encode_documents(docs, MODEL, outputs=("ids", "decoded")), taken


def test_encoder_takes_texts_by_bytes(encode):
    run, taken = encode
    texts = [None if k % 97 == 0 else f"wörd {k} " * (k % 1000) for k in range(2500)] + ["x y " * 400_000, "", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    rows = pa.Table.from_batches(list(run(iter([batch, batch.slice(0, 0), batch.slice(100, 50)])))).to_pylist()
    order = [*range(len(texts)), *range(100, 150)]
    assert [r["doc_id"] for r in rows] == order
    assert all(sum(own) <= 1 << 20 or len(own) == 1 for own in taken)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for at in [*range(0, len(order), 50), len(texts) - 3]:  # a text above the bound is encoded whole
        ids = library.encode(texts[order[at]] or "")
        assert rows[at]["ids"] == ids
        assert rows[at]["decoded"] == library.decode(ids)


def test_tasks_give_freed_memory_back(encode, monkeypatch):
    run, _ = encode
    given = []
    monkeypatch.setattr(common, "release", lambda: given.append(True))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["a b", "c"])], ["doc_id", "text"])
    assert len(list(run(iter([batch])))) == 1
    assert given == [True]
    begun = run(iter([batch, batch]))
    next(begun)
    begun.close()  # as under a limit
    assert given == [True, True]


def test_slices_by_bytes_keep_all_rows():
    texts = ["a" * 10, None, "b" * 25, "", "c" * 9, "d", "é" * 5, "e" * 30, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], ["doc_id", "text"])
    got = [b.column(0).to_pylist() for b in common.pieces([batch.slice(0, 4), batch.slice(4), batch.slice(0, 0)], 3, 20)]
    assert got == [[0, 1], [2], [3], [4, 5, 6], [7], [8]]
    assert [b.num_rows for b in common.pieces([batch], 4)] == [4, 4, 1]
