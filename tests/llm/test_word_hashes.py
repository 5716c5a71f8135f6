"""Word hashes straight from the bytes of many texts, and windows of blobs that are hashed together."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from valuary.llm import op8_substring_dedup as op8
from valuary.llm import words as words_module
from tests.llm.test_text_operators import prose, repeats_by_hand


def texts(rng):
    letters = ["a", "b", "\0", "é", "日", "\u0085", " ", " ", " ", "  ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1f"]
    some = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)]
    some += ["x" * n for n in range(1, 200)] + ["x" * n + "y" for n in range(200)] + ["", " ", "\n\n", "a" + " " * 5000 + "b"]
    return some


@pytest.mark.parametrize("block", [7, 32_768])
def test_words_and_their_hashes_are_those_of_split(monkeypatch, block):
    monkeypatch.setattr(words_module, "HASHED_WORDS", block)
    some = [t.encode() for t in texts(random.Random(1))]
    raw, starts, ends, lengths = op8._joined(some)
    words = [w for t in some for w in t.split()]
    assert [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())] == words
    assert lengths.tolist() == [len(t.split()) for t in some]
    found = [defaultdict(set), defaultdict(set)]
    for h, of in zip(op8.byte_hashes(np.frombuffer(raw, np.uint8), starts, ends), found):
        for word, x in zip(words, h.tolist()):
            of[word].add(x)
    for of in found:
        assert all(len(x) == 1 for x in of.values())
        assert len({x for y in of.values() for x in y}) == len(set(words))
    assert len(op8._joined([b"a" + b" " * 5000 + b"b"])[0]) < 50


def test_runs_are_equal_where_their_values_are():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**64, 3, np.uint64)[rng.integers(0, 3, 3000)]
    for width in range(1, 15):
        got = op8._runs(h, width, op8._MULTIPLIER).tolist()
        want = [tuple(h[i : i + width].tolist()) for i in range(len(h) - width + 1)]
        assert len(got) == len(want) and len(set(zip(got, want))) == len(set(got)) == len(set(want))
    assert len(op8._runs(h[:5], 13, op8._MULTIPLIER)) == 0


def test_windows_that_share_one_hash_are_told_apart():
    one, other = np.array([5, 5, 5, 5, 7, 9], np.uint64), np.array([1, 2, 1, 2, 1, 1], np.uint64)
    rows = op8._repeated(one, other, np.arange(6), np.array([3, 4, 8, 4, 1, 2]))
    assert rows.tolist() == [2]


class Caught:
    """Stands for a frame and keeps the function that would run over it."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self

    def repartition(self, *by):
        return self

    sortWithinPartitions = repartition


def test_no_word_is_looked_up_on_the_way_to_the_repeats(monkeypatch):
    rng = random.Random(3)
    base = prose(rng, 400).split()
    rows = [(i, " ".join(base[(a := rng.randrange(380)) : a + rng.randrange(60)] + prose(rng, 20).split())) for i in range(300)]
    rows += [(7, prose(rng, 50)), (None, " ".join(base)), (400, "")]
    monkeypatch.setattr(op8, "CHUNK_TEXT", 9000)
    monkeypatch.setattr(op8, "HASHED_TEXT", 5000)
    monkeypatch.setattr(op8, "Codes", None)
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "key": pa.array([0] * len(rows), pa.int64())})
    out, back = Caught(), Caught()
    op8.super_kmers(out, 5, 13)
    dealt = pa.Table.from_batches([*out.run(table.to_batches(100))]).sort_by("bucket")
    op8.repeated_windows(back, 13)
    spans = defaultdict(list)
    for batch in back.run(dealt.to_batches(20)):
        for r in batch.to_pylist():
            spans[r["doc_id"]].append(r["spans"])
    got = {d: int(op8.covered(len(t.split()), spans.get(op8.LAST if d is None else d, []), 13).sum()) for d, t in rows if d != 7}
    assert got == {d: n for d, _, n, _ in repeats_by_hand(rows) if d != 7} and any(got.values())


def test_a_blob_gives_its_words_back():
    blob = op8.pack(np.array([1, 2]), np.array([0, 0]), np.array([0, 4]), np.array([1, 2]), np.array([1, 0]), [b"c d e", b"a\nb"], zstandard.ZstdCompressor())
    *_, codes, words = op8.unpack(blob, zstandard.ZstdDecompressor())
    assert [words[c] for c in codes] == [b"a", b"b", b"c", b"d", b"e"]
