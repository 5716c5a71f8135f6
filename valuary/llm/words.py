"""Shared pieces: whitespace words, texts from Arrow columns, chunks of documents and hashes of many slices of text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

# The blanks that separate words.
BLANKS = r"[\x20\x09-\x0D]"
NOT_BLANK = r"[^\x20\x09-\x0D]"

# Text is worked on in chunks of about so many bytes, so a task's memory does not follow its partition.
CHUNK_BYTES = 8_000_000

HASHED_WORDS = 32_768
LONG_WORD = 64
_FIRST = np.uint64(0x9E3779B97F4A7C15)
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
_THIRD = np.uint64(0x94D049BB133111EB)
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow text column; null is the empty text, malformed UTF-8 is replaced."""
    try:
        return [t or "" for t in column.to_pylist()]
    except UnicodeDecodeError:
        raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
        return [(b or b"").decode("utf-8", "replace") for b in raw.to_pylist()]


def chunks(batches: Iterable[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their `text` as strings, each slice of about `size` bytes (one row at least). Only the
    strings of one slice are held at a time."""
    for batch in batches:
        column = batch.column("text")
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = min(int(np.searchsorted(ends, before + size)) + 1, batch.num_rows)
            rows = batch.slice(start, stop - start)
            yield rows, texts_of(rows.column("text"))
            start = stop


class Codes(dict):
    """Numbers its keys in the order of their first lookup."""

    def __missing__(self, key):
        self[key] = code = len(self)
        return code


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices values[starts : starts + lengths], one after another."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(lengths)
    shift = np.repeat(starts - (ends - lengths), lengths)
    return values[np.arange(total) + shift]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the bytes starts and ends; they begin and end with blanks."""
    blank = (data - np.uint8(0x09) < 5) | (data == 0x20)
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    return edge[::2], edge[1::2]


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each slice of the bytes, eight bytes at a time; at least eight bytes follow the last.
    Those of a very long one are the halves of one 128-bit hash."""
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    length = ends - starts
    h1, h2 = (length.astype(np.uint64) * m for m in (_SECOND, _FIRST))

    def take(rows, at: int) -> None:
        x = eights[starts[rows] + at] & _LOW_BYTES[np.minimum(length[rows] - at, 8)]
        for h, m in ((h1, _FIRST), (h2, _SECOND)):
            y = (h[rows] ^ x) * m
            y ^= y >> np.uint64(32)
            y *= _THIRD
            y ^= y >> np.uint64(29)
            h[rows] = y

    for i in range(0, len(starts), HASHED_WORDS):
        some = slice(i, i + HASHED_WORDS)
        take(some, 0)
        rows, at = i + np.flatnonzero((length[some] > 8) & (length[some] <= LONG_WORD)), 8
        while len(rows):
            take(rows, at)
            at += 8
            rows = rows[length[rows] > at]
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        h1[i], h2[i] = np.frombuffer(xxhash.xxh3_128_digest(data[starts[i] : ends[i]]), np.uint64)
    return h1, h2
