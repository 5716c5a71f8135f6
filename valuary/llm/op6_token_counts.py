"""Token counts from distinct pre-tokens: every pre-token is counted once, no text is turned into ids.

1. One pass over the texts cuts them into pre-tokens. Per chunk of documents it writes the chunk's vocabulary
   (one row) and for every document the codes and frequencies of its pre-tokens.
2. The vocabularies are grouped by pre-token over all chunks; the library counts each distinct pre-token once. A
   pre-token that stands in every text is one entry a chunk here, so no group is larger than the number of chunks.
3. The counts return to their chunks, meet the documents' frequencies there and are multiplied and summed.

Special strings are matched by the library before it cuts pre-tokens; here they are cut out first and counted
like pre-tokens, which gives the same sums.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted one by one; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuary.llm.pretokens import pretokens
from valuary.llm.registry import query, table
from valuary.llm.tokens import library_tokenizer
from valuary.llm.words import Codes, chunks
from valuary.session import stage_table

BYTE_BPE = "byte_bpe_50k.json"
LIMIT = 512
# So many distinct pre-tokens go to the library at once, and so many counts are sent back together.
BATCH = 20_000
FLUSH = 1_000_000
# Texts of one chunk (and so of one vocabulary), in characters.
CHUNK_TEXT = 24_000_000


@lru_cache(maxsize=4)
def _special(path: str) -> re.Pattern | None:
    with open(path, encoding="utf-8") as lines:
        strings = [t["content"] for t in json.load(lines)["added_tokens"]]
    return re.compile("(" + "|".join(map(re.escape, sorted(strings, key=len, reverse=True))) + ")") if strings else None


def _cut(text: str, special: re.Pattern | None) -> list[str]:
    if special is None or not special.search(text):
        return pretokens(text)
    out = []
    for i, part in enumerate(special.split(text)):
        out += [part] if i % 2 else pretokens(part)
    return out


def _packed(ascending: np.ndarray, values: np.ndarray, press) -> bytes:
    """Codes in ascending order and a number for each, compressed."""
    steps = np.diff(ascending, prepend=0).astype("<u4")
    return press.compress(steps.tobytes() + values.astype("<u4").tobytes())


def _unpacked(raw: bytes, press) -> tuple[np.ndarray, np.ndarray]:
    steps, values = np.frombuffer(press.decompress(raw), "<u4").reshape(2, -1)
    return np.cumsum(steps.astype(np.int64)), values.astype(np.int64)


def frequencies(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Staged rows of two kinds: `words` (a chunk's vocabulary, by code) or a document with its codes' frequencies."""
    schema = pa.schema(
        [("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("times", pa.binary()), ("words", pa.list_(pa.string()))]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        special, press = _special(tokenizer), zstandard.ZstdCompressor(level=1)
        chunk, vocabulary, size = TaskContext.get().partitionId() << 32, Codes(), 0

        def rows_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for rows, texts in chunks(batches):
            place, out = vocabulary.__getitem__, []
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), texts):
                codes, times = np.unique(np.fromiter(map(place, _cut(text, special)), np.uint32), return_counts=True)
                out.append((chunk, doc_id, len(text.encode()), _packed(codes, times, press), None))
                size += len(text)
            yield rows_of(out)
            if size >= CHUNK_TEXT:
                yield rows_of([(chunk, None, None, None, list(vocabulary))])
                chunk, vocabulary, size = chunk + 1, Codes(), 0
        if size or vocabulary:
            yield rows_of([(chunk, None, None, None, list(vocabulary))])

    kinds = "chunk long, doc_id long, n_bytes long, times binary, words array<string>"
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stage_table(ids.mapInArrow(run, kinds), "pretoken-frequencies")


def piece_counts(staged: DataFrame, tokenizer: str) -> DataFrame:
    """(chunk, counts): codes and numbers of tokens; the library sees each distinct pre-token of the corpus once.

    Equal pre-tokens of all chunks lie side by side in one partition; each is at most one row a chunk."""
    words = staged.where(F.col("words").isNotNull()).select("chunk", F.posexplode("words").alias("code", "word"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press, encode = zstandard.ZstdCompressor(level=1), library_tokenizer(tokenizer).encode_batch_fast
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        last, n_last, size = None, 0, 0

        def flush() -> pa.RecordBatch:
            chunk, code, n = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((code, chunk))
            chunk, code, n = chunk[order], code[order], n[order]
            cuts = np.flatnonzero(np.diff(chunk)) + 1
            heads = chunk[np.append(0, cuts)]
            packed = [_packed(c, k, press) for c, k in zip(np.split(code, cuts), np.split(n, cuts))]
            return pa.RecordBatch.from_arrays([pa.array(heads, pa.int64()), pa.array(packed, pa.binary())], ["chunk", "counts"])

        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                words_here = part.column("word").to_pylist()
                new = np.fromiter((a != b for a, b in zip(words_here, [last, *words_here])), bool, len(words_here))
                counted = [len(e) for e in encode([w for w, k in zip(words_here, new.tolist()) if k], add_special_tokens=False)]
                n = np.array([n_last, *counted], np.int64)[np.cumsum(new)]
                last, n_last = words_here[-1], int(n[-1])
                held.append((part.column("chunk").to_numpy(), part.column("code").to_numpy().astype(np.int64), n))
                size += len(n)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    together = words.repartition("word").sortWithinPartitions("word")
    return together.mapInArrow(run, "chunk long, counts binary")


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row of `docs`."""
    staged = frequencies(docs, tokenizer)
    counts = piece_counts(staged, tokenizer)
    documents = staged.where(F.col("words").isNull()).select("chunk", "doc_id", "n_bytes", "times")
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def total(pieces: pa.Table, rows: pa.Table) -> pa.Table:
        import zstandard

        press = zstandard.ZstdDecompressor()
        parts = [_unpacked(c, press) for c in pieces.column("counts").to_pylist()]
        per_code = np.zeros(max((int(c[-1]) + 1 for c, _ in parts if len(c)), default=0), np.int64)
        for code, n in parts:
            per_code[code] = n
        n_tokens = []
        for raw in rows.column("times").to_pylist():
            code, times = _unpacked(raw, press)
            n_tokens.append(int((per_code[code] * times).sum()))
        return pa.table([rows.column("doc_id"), rows.column("n_bytes"), pa.array(n_tokens, pa.int64())], schema=out)

    summed = (
        counts.groupBy("chunk").cogroup(documents.groupBy("chunk")).applyInArrow(total, "doc_id long, n_bytes long, n_tokens long")
    )
    return summed.withColumn("over_limit", F.col("n_tokens") > limit)


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
