"""Chunks of documents: slices of about so many bytes, whose strings alone are held."""

import pyarrow as pa

from valuary.llm import words


def test_slices_hold_only_their_own_strings(monkeypatch):
    texts = ["é" * 10, None, "", "a" * 50, "b" * 5, "c" * 5, "d" * 30]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(7)), "text": texts}, pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
    made = []
    whole = words.texts_of
    monkeypatch.setattr(words, "texts_of", lambda column: made.append(len(column)) or whole(column))
    got = [(rows.column("doc_id").to_pylist(), t) for rows, t in words.chunks([batch, batch.slice(0, 0), batch.slice(4)], 20)]
    assert [i for i, _ in got] == [[0], [1, 2, 3], [4, 5, 6], [4, 5, 6]]
    assert [x for _, t in got[:3] for x in t] == [t or "" for t in texts]
    assert made == [1, 3, 3, 3]


def test_slices_of_malformed_text():
    raw = pa.array([b"ab", b"\xff\xfe", None], pa.binary())
    column = pa.Array.from_buffers(pa.string(), 3, raw.buffers())
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    assert [t for _, t in words.chunks([batch], 2)] == [["ab"], ["��"], [""]]
