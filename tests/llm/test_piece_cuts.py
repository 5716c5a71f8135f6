"""Pieces that a worker remembers: stems apart from their marks and from line breaks, by hash."""

import random

import numpy as np
import public_tokenizers
import pytest

from valuary.llm.tokens import PieceMemory

TOKENIZERS = ["word_bpe_49k.json", "byte_bpe_50k.json"]


@pytest.mark.parametrize("name", TOKENIZERS)
def test_marks_and_line_breaks_make_no_new_pieces(name):
    memory = PieceMemory(public_tokenizers.path(name))
    memory.encode(["The the cat end dog. a, b", "End The\nThe"])
    known = len(memory.codes)
    texts = ["The the, cat.\nThe dog, end.\nEnd the a, b. cat,", "", "End, the end"]
    ids, counts = memory.encode(texts)
    assert len(memory.codes) == known
    assert ids.tolist() == [i for t in texts for i in memory.library.encode(t, add_special_tokens=False).ids]
    assert counts.tolist() == [len(memory.library.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("name", TOKENIZERS)
def test_cuts_at_marks_breaks_and_wide_blanks_encode_as_in_the_library(name):
    rng = random.Random(11)
    some = ["a", "The", "é", "ŉ", "İ", "ß", "×", "÷", "7", "'s", "'", "x", "ſ", "̇", "́", "日", "🙂", "<|endoftext|>", "\0", "\x1c"]
    some += [*".,;:!?$%&#*", "-", "|", "“", *["\n", " ", "\t", "\r"] * 3, "\u0085", " ", " ", "　", "​", "﻿"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(30))) for _ in range(6000)]
    memory = PieceMemory(public_tokenizers.path(name), limit=300)
    for part in (texts[:3000], texts[3000:], texts[2000:5000]):
        ids, counts = memory.encode(part)
        got = np.split(ids, np.cumsum(counts)[:-1])
        for text, mine, other in zip(part, got, memory.library.encode_batch(part, add_special_tokens=False)):
            assert mine.tolist() == other.ids, repr(text)


def test_capitals_go_to_the_model_where_no_normaliser_lowers_them():
    memory = PieceMemory(public_tokenizers.path("byte_bpe_50k.json"))
    sent = []

    class Library:
        def encode_batch_fast(self, strings, **how):
            sent.extend(strings)
            return real.encode_batch_fast(strings, **how)

    real, memory.library = memory.library, Library()
    text = "Then The ÉLAN, aÑb 7 x"
    ids, _ = memory.encode([text])
    assert sent == [",", " 7"]
    assert ids.tolist() == real.encode(text, add_special_tokens=False).ids


def test_hashes_that_share_a_half_are_different_pieces(monkeypatch):
    from valuary.llm import tokens

    real = tokens.byte_hashes
    monkeypatch.setattr(tokens, "byte_hashes", lambda *args: (real(*args)[0] % np.uint64(3), real(*args)[1]))
    memory = PieceMemory(public_tokenizers.path("byte_bpe_50k.json"))
    text = "some words that share the first half of the hash and the words again"
    for _ in range(2):
        ids, _ = memory.encode([text])
        assert ids.tolist() == memory.library.encode(text, add_special_tokens=False).ids
