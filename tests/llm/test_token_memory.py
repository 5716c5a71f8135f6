"""What a worker keeps of tokens: words instead of runs across line breaks, and few pieces."""

import inspect
import random

import numpy as np
import public_tokenizers
import pytest

from valuary.llm.tokens import PieceMemory

BLANKS = [chr(c) for c in range(0x3001) if chr(c).isspace()]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_capitals_and_all_kinds_of_blanks_encode_as_in_the_library(name):
    rng = random.Random(3)
    letters = [chr(c) for c in range(0x21, 0x200)] + ["́", "​", "Σ", "ς", "İ", "<|endoftext|>", "'s", "'LL"]
    texts = [f"ab{b}Cd.{b}{b}é{b}" for b in BLANKS] + [f"{b}́x{b}7 \n{b}'s" for b in BLANKS]
    texts += [f"x{c}y {c.upper()}z\n{c}. A{c}" for c in letters]
    texts += ["".join(rng.choice(["The", "ÉLan", "x", *letters, *BLANKS, " ", "\n", ". "]) for _ in range(40)) for _ in range(1500)]
    memory = PieceMemory(public_tokenizers.path(name), limit=400)
    for some in (texts[:200], texts, texts):
        ids, counts = memory.encode(some)
        got = np.split(ids, np.cumsum(counts)[:-1])
        for text, mine, other in zip(some, got, memory.library.encode_batch(some, add_special_tokens=False)):
            assert mine.tolist() == other.ids, text


def test_words_across_a_line_break_are_known_words():
    memory = PieceMemory(public_tokenizers.path("word_bpe_49k.json"))
    memory.encode(["the end. The start\tof it"])
    known = len(memory.codes)
    memory.encode(["of\nthe start\n\nit end.\nThe", " the\r\nstart "])
    assert len(memory.codes) == known


def test_plain_words_with_capitals_go_to_the_model():
    memory = PieceMemory(public_tokenizers.path("word_bpe_49k.json"))
    sent = []

    class Library:
        def encode_batch_fast(self, strings, **how):
            sent.extend(strings)
            return real.encode_batch_fast(strings, **how)

    real, memory.library = memory.library, Library()
    words_ = "The ÉLAN aÑb İx Straße d'Or x1"
    ids, _ = memory.encode([words_])
    assert sent == [" İx", " d'Or", " x1"]
    assert ids.tolist() == real.encode(words_, add_special_tokens=False).ids


def test_a_worker_keeps_a_quarter_of_a_million_pieces_at_most():
    assert inspect.signature(PieceMemory).parameters["limit"].default <= 250_000
