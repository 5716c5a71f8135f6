"""Token ids by the tokenizers library, each distinct piece of a chunk of documents encoded once."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from valuary.llm.words import byte_hashes, chunks, gather

MARKS = ".,;:!?$%&#*"
# Python takes these four for blanks, the library's patterns don't.
SEPARATORS = "\x1c\x1d\x1e\x1f"
# Texts are worked on in chunks of so many bytes: a worker stays, with its memory, through the stages that follow.
CHUNK_TEXT = 2_000_000
_MARK = np.isin(np.arange(256), list(MARKS.encode()))
# The blanks of more than one byte.
_WIDE_BLANK = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


@lru_cache(maxsize=4)
def library_tokenizer(path: str):
    """The tokenizer of a .json file, one a Python worker, without threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters(library) -> dict[str, str]:
    """The character that stands for each byte in a byte-level model, as the library's own component gives it."""
    from tokenizers.pre_tokenizers import ByteLevel

    whole = ByteLevel(add_prefix_space=False, use_regex=False)
    letters = {chr(b): whole.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
    for point in range(0x80, 0x800):
        for byte, letter in zip(chr(point).encode(), whole.pre_tokenize_str(chr(point))[0][0]):
            letters[chr(byte)] = letter
    return letters


@lru_cache(maxsize=4)
def _memory(path: str) -> "PieceMemory":
    return PieceMemory(path)


class PieceMemory:
    """Ids of the pieces seen in this worker, by the 128-bit hash of their bytes. Beyond `limit` pieces it keeps the half
    that was used most; it never changes a result."""

    def __init__(self, path: str, limit: int = 250_000):
        self.path, self.limit = path, limit
        # Two halves of each hash, sorted by the first, and the number of its piece.
        self.h1, self.h2, self.codes = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.lengths, self.uses = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.library = library_tokenizer(path)
        self.model = self.library.model
        letters = _byte_letters(self.library)
        self.blank_letter, self.letters = letters[" "], [letters.get(chr(b), "") for b in range(256)]
        self.lowers, self.plain = self._plain()
        self.blank = self._blank()
        self.bare = all(self._encode(w) == self._word("", w) for w in self._samples())
        self.splits = self._splits()
        self.closes = np.zeros((256, 256), bool)
        self.lines = False
        self._ask_cuts()

    def _encode(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _plain(self) -> tuple[bool, re.Pattern]:
        """Whether the library's normaliser writes Latin letters small, and a pattern of those that it leaves alone otherwise."""
        normalizer = self.library.normalizer
        said = normalizer.normalize_str if normalizer else str
        lowers = said("aB") == "ab"
        letters = [c for c in map(chr, range(0x180)) if c.isalpha() and (len(c.lower()) == 1 or not lowers)]
        return lowers, re.compile(f"[{''.join(c for c in letters if said(f'a{c}') == (f'a{c.lower()}' if lowers else f'a{c}'))}]+")

    def _samples(self) -> tuple[str, ...]:
        return "a", "the", "unheimlichkeit", "straße", "thth", "é", "ñandú", "The", "THth", "Élan", "aÑb"

    def _blank(self) -> str | None:
        """What a blank before a plain word becomes inside the model; None if words don't reach it whole."""
        for mark in (self.blank_letter, ""):
            if all(self._encode(f" {w}") == self._word(mark, w) for w in self._samples()):
                return mark
        return None

    def _splits(self) -> bool:
        """Whether the library cuts at all blanks and drops them, so that a text is the sequence of its words."""
        blanks = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in SEPARATORS]
        left, right = ("", "a", "A.", "7", "'", "\u0301"), ("", "a", ".A", "7", "s", "\u0301a")
        return self.blank == "" and all(
            self._encode(f"{a}{b}{c}") == self._encode(a) + self._encode(f" {c}" if c else "")
            for b in (*blanks, "  ", " \n", "\n\n", "\t ") for a in left for c in right
        )

    def _word(self, mark: str, word: str) -> list[int]:
        if self.lowers:
            word = word.lower()
        if not word.isascii():
            word = "".join([self.letters[b] for b in word.encode()])
        return [t.id for t in self.model.tokenize(mark + word)]

    def _ask_cuts(self) -> None:
        """Asks the library whether texts may be cut between a letter and a mark, and around a single line break. Letters
        whose lower-case form ends in a mark, which joins the marks behind it, aren't cut from them."""
        encode = self._encode
        rights = ("", "b", ".A", "7", "'s", "é", "\u0301a", " b", "\n", "$")
        lefts = ("a", " the", "A", "é", "ß", "x1a")
        if all(encode(a + m + b) == encode(a) + encode(m + b) for a in lefts for m in MARKS for b in rights):
            normalizer = self.library.normalizer
            for c in filter(str.isalpha, map(chr, range(0x180))):
                said = normalizer.normalize_str(f"a{c}") if normalizer else f"a{c}"
                if len(said) == 2 and said.isalpha():
                    *lead, last = c.encode()
                    self.closes[lead[0] if lead else slice(None), last] = True
        self.lines = all(encode(f"{a}\n{b}") == encode(a) + encode("\n") + encode(b) for a in (*lefts, "A.", "7", "'") for b in rights[1:7])
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        cut = self._cut(special)[3].tolist()
        asked, self.closes, self.lines = (self.closes, self.lines), np.zeros((256, 256), bool), False
        if cut == self._cut(special)[3].tolist():
            self.closes, self.lines = asked

    def _library(self, pieces: list[str]) -> list[list[int]]:
        """Ids of the pieces. Plain words of Latin letters go straight to the library's model: but for their case,
        normalisers leave them alone, and they are one pre-token, which saves half of the time."""
        found: list = [None] * len(pieces)
        other = []
        plain, word, blank, bare, splits = self.plain.fullmatch, self._word, self.blank, self.bare, self.splits
        for i, piece in enumerate(pieces):
            if splits:
                if plain(piece):
                    found[i] = word(blank, piece)
                    continue
            elif piece[:1] == " ":
                if blank is not None and plain(piece, 1):
                    found[i] = word(blank, piece[1:])
                    continue
            elif bare and plain(piece):
                found[i] = word("", piece)
                continue
            other.append(i)
        strings = [f" {pieces[i]}" if splits else pieces[i] for i in other]
        for i, e in zip(other, self.library.encode_batch_fast(strings, add_special_tokens=False)):
            found[i] = e.ids
        return found

    def _cut(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """The texts' bytes in one string, where each piece starts and ends in it, and how many each text has.

        Where the library drops all blanks, pieces are the words; otherwise a text is cut in front of each single blank
        between two other characters and around such a line break. Marks are cut from the letter before them. No
        pre-token crosses such a place."""
        coded = [t.encode() for t in texts]
        raw = b"\n\n" + b"\n\n".join(coded) + b"\n" * 10
        data = np.frombuffer(raw, np.uint8)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        begin = 2 + np.cumsum(sizes + 2) - (sizes + 2)
        blank = (data - np.uint8(0x09) < 5) | (data == 0x20)
        if not raw.isascii():
            for m in _WIDE_BLANK.finditer(raw):
                blank[m.start() : m.end()] = True
        marks = np.flatnonzero(_MARK[data])
        marks = marks[self.closes[data[marks - 2], data[marks - 1]]]
        if self.splits:
            edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
            starts, ends = (np.sort(np.concatenate([x, marks])) for x in (edge[::2], edge[1::2]))
        else:
            alone = 1 + np.flatnonzero(blank[1:-1] & ~blank[:-2] & ~blank[2:])
            line = alone[data[alone] == 0x0A] if self.lines else alone[:0]
            starts = np.sort(np.concatenate([begin[sizes > 0], alone[data[alone] == 0x20], line, line + 1, marks]))
            ends = np.append(starts[1:], 0)[: len(starts)]
            some = sizes > 0
            ends[np.searchsorted(starts, (begin + sizes)[some]) - 1] = (begin + sizes)[some]
        return raw, starts, ends, np.diff(np.searchsorted(starts, np.append(begin, len(raw))))

    def _forget(self) -> None:
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: self.limit // 2])
        starts = np.cumsum(self.lengths) - self.lengths
        self.ids = gather(self.ids, starts[kept], self.lengths[kept])
        number = np.full(len(self.lengths), -1)
        number[kept] = np.arange(len(kept))
        codes = number[self.codes]
        self.h1, self.h2, self.codes = (x[codes >= 0] for x in (self.h1, self.h2, codes))
        self.lengths, self.uses = self.lengths[kept], self.uses[kept] // 2

    def _learn(self, h1: np.ndarray, h2: np.ndarray, pieces: list[str]) -> None:
        found = self._library(pieces)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
        codes = np.concatenate([self.codes, len(self.lengths) + np.arange(len(found))])
        h1, h2 = np.concatenate([self.h1, h1]), np.concatenate([self.h2, h2])
        order = np.argsort(h1)
        self.h1, self.h2, self.codes = h1[order], h2[order], codes[order]
        self.ids, self.lengths = np.concatenate([self.ids, flat]), np.concatenate([self.lengths, lengths])
        self.uses = np.concatenate([self.uses, np.zeros(len(found), np.int64)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        if len(self.codes) > self.limit:
            self._forget()
        raw, starts, ends, counts = self._cut(texts)
        h1, h2 = byte_hashes(np.frombuffer(raw, np.uint8), starts, ends)
        order = np.argsort(h1)
        h1, h2 = h1[order], h2[order]
        new = np.ones(len(order), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        heads = np.flatnonzero(new)
        h1, h2, first = h1[heads], h2[heads], order[heads]
        code, known = np.zeros(len(heads), np.int64), np.zeros(len(heads), bool)
        if len(self.h1):
            at = np.minimum(np.searchsorted(self.h1, h1), len(self.h1) - 1)
            known = (self.h1[at] == h1) & (self.h2[at] == h2)
            code = self.codes[at]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            # In the order in which the texts hold them.
            fresh = fresh[np.argsort(first[fresh])]
            code[fresh] = len(self.lengths) + np.arange(len(fresh))
            places = zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist())
            self._learn(h1[fresh], h2[fresh], [raw[a:b].decode() for a, b in places])
        piece = np.empty(len(order), np.int64)
        piece[order] = np.repeat(code, np.diff(np.append(heads, len(order))))
        self.uses += np.bincount(piece, minlength=len(self.uses))
        per_piece = self.lengths[piece]
        ids = gather(self.ids, (np.cumsum(self.lengths) - self.lengths)[piece], per_piece)
        sums = np.concatenate([[0], np.cumsum(per_piece)])
        return ids, np.diff(sums[np.concatenate([[0], np.cumsum(counts)])])


def encoded(batches: Iterable[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches with the ids of every text, each document closed by `end_id`."""
    end = np.array([end_id], np.uint32)
    for rows, texts in chunks(batches, CHUNK_TEXT):
        ids, counts = _memory(path).encode(texts)
        stops = np.cumsum(counts)
        yield rows, [np.concatenate([ids[b - n : b], end]) for b, n in zip(stops.tolist(), counts.tolist())]
