"""Byte-level BPE encoding and decoding by a rank queue over a hierarchical bitmap.

The pre-tokens of a chunk stand one behind another in a linked list of symbols. Every adjacent pair that has a
merge rank lies in that rank's bucket; a bitmap over the ranks, with summary levels of 64-bit words above it,
gives the lowest non-empty bucket by find-first-set. A bucket is drained as a whole: entries whose pair has
changed since are skipped as stale, overlapping pairs are merged from the left, and the new pairs on both sides
are filed under their own ranks. Work follows the number of merges, so one pre-token of a whole long text costs
no more a byte than short ones. The lowest rank first, leftmost first, is the order of the byte-pair rule; where
a vocabulary holds a token that ranks before one of its own parts, the entries of a bucket that could be
overtaken are drained one at a time.

Defined results: a null or empty text has no ids; malformed UTF-8 is replaced first; repeated rows are encoded
one by one; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from valuary.llm.pretokens import pretokens
from valuary.llm.registry import query, table
from valuary.llm.words import Codes, chunks, gather

RANKS = "byte_bpe_50k.tiktoken"
NONE = -1


class RankBitmap:
    """A set of small integers: bit i of level 0 says that i is in it, each higher level which words below it aren't zero."""

    def __init__(self, size: int):
        self.levels = []
        while True:
            size = -(-size // 64)
            self.levels.append([0] * size)
            if size == 1:
                break

    def add(self, i: int) -> None:
        for level in self.levels:
            i, bit = i >> 6, 1 << (i & 63)
            old = level[i]
            level[i] = old | bit
            if old:
                return

    def remove(self, i: int) -> None:
        for level in self.levels:
            i, bit = i >> 6, 1 << (i & 63)
            level[i] &= ~bit
            if level[i]:
                return

    def first(self) -> int:
        """The smallest member, or -1."""
        i = 0
        for level in reversed(self.levels):
            word = level[i]
            if not word:
                return NONE
            i = i << 6 | (word & -word).bit_length() - 1
        return i


class Vocabulary:
    """Tokens by rank, the rank of every pair of tokens that joins to a token, and which ranks can be overtaken."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_rank = np.full(256, NONE, np.int64)
        for b in range(256):
            self.byte_rank[b] = ranks.get(bytes([b]), NONE)
        keys, values, overtaken = [], [], set()
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    values.append(rank)
                    overtaken.update(x for x in (a, b) if x > rank)
        order = np.argsort(np.array(keys, np.int64)) if keys else np.zeros(0, np.int64)
        self.pair_keys = np.concatenate([np.array(keys, np.int64)[order], [np.iinfo(np.int64).max]])
        self.pair_ranks = np.concatenate([np.array(values, np.int64)[order], [NONE]])
        self.overtaken = overtaken
        self.lookup = dict(zip(keys, values))

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it joins to no token."""
        keys = left * self.size + right
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a rank file, one a Python worker."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)})


def encode_words(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the byte strings, one after another, and how many each has."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64), lengths
    symbol = vocab.byte_rank[np.frombuffer(b"".join(words), np.uint8)]
    word_of = np.repeat(np.arange(len(words)), lengths)
    # One place more at either end, so that a missing neighbour is place `total`, whose pairs have no rank.
    after = np.arange(1, total + 1)
    after[np.cumsum(lengths)[lengths > 0] - 1] = total
    before = np.full(total + 1, total)
    before[after[after < total]] = np.flatnonzero(after < total)
    alive = np.ones(total, bool)
    rank = np.full(total + 1, NONE)
    inner = np.flatnonzero(after < total)
    rank[inner] = vocab.ranks_of(symbol[inner], symbol[after[inner]])

    buckets: dict[int, list[np.ndarray]] = {}
    queue = RankBitmap(vocab.size)

    def file(places: np.ndarray) -> None:
        places = places[rank[places] >= 0]
        if not len(places):
            return
        of = rank[places]
        order = np.argsort(of, kind="stable")
        places, of = places[order], of[order]
        cuts = np.flatnonzero(np.diff(of)) + 1
        for r, group in zip(of[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts)):
            if r in buckets:
                buckets[r].append(group)
            else:
                buckets[r] = [group]
                queue.add(r)

    file(inner)
    while (r := queue.first()) >= 0:
        queue.remove(r)
        entries = buckets.pop(r)
        at = np.unique(np.concatenate(entries)) if len(entries) > 1 else np.sort(entries[0])
        at = at[rank[at] == r]
        if not len(at):
            continue
        if r in vocab.overtaken and len(at) > 1:
            # Only the leftmost pair of each word now; the others wait behind whatever it gives rise to.
            first = np.concatenate([[True], np.diff(word_of[at]) > 0])
            if not first.all():
                buckets[r] = [at[~first]]
                queue.add(r)
                at = at[first]
        elif len(at) > 1:
            # In a chain of overlapping pairs every second one is merged.
            chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
            if chained.any():
                heads = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - heads) % 2 == 0]
        gone = after[at]
        beyond = after[gone]
        symbol[at] = r
        alive[gone] = False
        rank[gone] = NONE
        after[at] = beyond
        before[beyond] = at
        before[total] = total
        left = before[at]
        left = left[left < total]
        # A left neighbour that is itself merged now has been set above; its pair is looked up with the rest.
        changed = np.union1d(at, left)
        inside = after[changed] < total
        rank[changed[~inside]] = NONE
        changed = changed[inside]
        rank[changed] = vocab.ranks_of(symbol[changed], symbol[after[changed]])
        file(changed)
    left_over = np.flatnonzero(alive)
    return symbol[left_over], np.bincount(word_of[left_over], minlength=len(words))


def decode_ids(ids: Iterable[int], vocab: Vocabulary) -> bytes:
    return b"".join(map(vocab.tokens.__getitem__, ids))


def encode_texts(texts: list[str], vocab: Vocabulary) -> Iterator[np.ndarray]:
    """The ids of every text; a pre-token that stands in several texts of the list is encoded once."""
    codes = Codes()
    coded = [np.fromiter(map(codes.__getitem__, pretokens(t)), np.int64) for t in texts]
    ids, counts = encode_words([w.encode() for w in codes], vocab)
    starts = np.cumsum(counts) - counts
    for c in coded:
        yield gather(ids, starts[c], counts[c])


def encode_documents(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id and the ids of every text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            ids = [a.astype(np.int32) for a in encode_texts(texts, vocabulary(ranks))]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id and the bytes that its ids stand for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plain = [decode_ids(ids or (), vocabulary(ranks)) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(plain, pa.binary())], ["doc_id", "bytes"])

    return encoded.mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, bytes binary")


def digest_documents(docs: DataFrame, ranks: str) -> DataFrame:
    """Encoding and decoding in one pass: counts and hashes, without carrying the ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(ranks)
        for rows, texts in chunks(batches):
            n, said, plain = [], [], []
            for ids in encode_texts(texts, vocab):
                ids = ids.tolist()
                n.append(len(ids))
                said.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                plain.append(hashlib.sha256(decode_ids(ids, vocab)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(plain, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


@query("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))
