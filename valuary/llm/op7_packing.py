"""Best-fit packing of token sequences by the linear grouping scheme.

Documents are tokenised and cut into pieces of at most `capacity` ids. All decisions are made on the histogram
of piece lengths, which has at most `capacity` entries whatever the input:

1. pieces of more than capacity / `small_parts` ids are large; their counts, longest first, are split into
   `groups` groups of equal cardinality and rounded up to the longest length of their group;
2. configurations (multisets of rounded sizes that fit) are chosen for the few sizes: the longest size that is
   left, filled up by the subset of the others that wastes least, repeated while its members last;
3. actual pieces are substituted, longest first inside a group, so every stretch of sequences with the same
   members has a known, exact room left;
4. small pieces go, longest first, to the fullest sequences that still hold them.

The result is a short list of slots (length, range of ranks, first sequence, offset). Spark numbers the pieces
of each length (counts per chunk of input, prefix sums, numbers inside a chunk; a common length is dealt over all
chunks) and joins them with the slots.

Defined results: a null or empty text is the end id alone; only documents of more than `capacity` ids are cut;
repeated rows are packed one by one; extra columns are ignored; an empty table packs into nothing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from valuary.llm.registry import query, table
from valuary.llm.tokens import encoded
from valuary.session import broadcast_if_small, materialise, stage_table

WORD_BPE = "word_bpe_49k.json"
END_ID = 0
CAPACITY = 2048


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Staged pieces: chunk (the writing task), doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids in encoded(batches, tokenizer, end_id):
            out = [
                (doc_id, at // capacity, at, len(p := a[at : at + capacity]), zlib.crc32(p.astype("<u4").tobytes()))
                for doc_id, a in zip(rows.column("doc_id").to_pylist(), ids)
                for at in range(0, len(a), capacity)
            ]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    out = "doc_id long, piece int, start long, length long, ids_crc32 long"
    cut_rows = docs.select("doc_id", "text").mapInArrow(cut, out)
    return stage_table(cut_rows.withColumn("chunk", F.spark_partition_id()), "token-pieces")


class _Fill:
    """Best subset of the sizes that are left, below a room: sizes are few, each used at most as often as it is left."""

    def __init__(self, sizes: list[int], left: list[int]):
        self.sizes, self.left = sizes, left

    def best(self, first: int, room: int) -> list[int]:
        """Indices of sizes (from `first` on, longest first) whose sum comes closest to `room` from below."""
        usable = [i for i in range(first, len(self.sizes)) if self.left[i] and self.sizes[i] <= room]
        reach: dict[int, tuple[int, int]] = {0: (-1, 0)}  # sum: (size used last, sum before)
        for i in usable:
            size = self.sizes[i]
            for base in sorted(reach, reverse=True):
                total, used = base, 0
                while used < self.left[i] and (total := total + size) <= room and total not in reach:
                    reach[total] = (i, total - size)
                    used += 1
            if room in reach:
                break
        total, out = max(reach), []
        while total:
            i, total = reach[total]
            out.append(i)
        return out


def round_up(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths with their counts, longest first, in groups of equal cardinality; a length may span groups."""
    total = sum(counts.values())
    share, out, room = max(1, -(-total // groups)), [[]], max(1, -(-total // groups))
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not room:
                out.append([])
                room = share
            take = min(n, room)
            out[-1].append((length, take))
            n, room = n - take, room - take
    return [g for g in out if g]


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY, groups: int = 512, small_parts: int = 3) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, how many, first sequence, offset): pieces of a length are ranked from 0; the piece of
    rank first + i stands in sequence first sequence + i."""
    slots: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    used: dict[int, int] = defaultdict(int)  # ranks given out, by length

    def place(length: int, n: int, first_sequence: int, offset: int) -> None:
        slots.append((length, used[length], n, first_sequence, offset))
        used[length] += n

    if counts.get(capacity):
        place(capacity, counts[capacity], sequence, 0)
        sequence += counts[capacity]
    large = {k: n for k, n in counts.items() if capacity // small_parts < k < capacity and n}
    small = {k: n for k, n in counts.items() if 0 < k <= capacity // small_parts and n}

    # Rounded sizes and configurations.
    grouped = round_up(large, groups) if large else []
    sizes = [g[0][0] for g in grouped]
    left = [sum(n for _, n in g) for g in grouped]
    fill = _Fill(sizes, left)
    # Sequences that stand alike: room left, first sequence, how many.
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)
    at = [0] * len(grouped)  # entry of the group that its next piece comes from
    rest = [list(n for _, n in g) for g in grouped]

    def take(i: int, n: int) -> Iterator[tuple[int, int]]:
        """The next n actual pieces of group i, as (length, how many)."""
        while n:
            length, have = grouped[i][at[i]][0], rest[i][at[i]]
            k = min(n, have)
            rest[i][at[i]] -= k
            at[i] += rest[i][at[i]] == 0
            n -= k
            yield length, k

    for i in range(len(sizes)):
        while left[i]:
            left[i] -= 1
            others = fill.best(i, capacity - sizes[i])
            left[i] += 1
            members: dict[int, int] = defaultdict(int, {i: 1})
            for j in others:
                members[j] += 1
            times = min(left[j] // k for j, k in members.items())
            runs = [[*take(j, times)] for j, k in members.items() for _ in range(k)]
            for j, k in members.items():
                left[j] -= k * times
            # Cut the stretch where any member's actual length changes.
            done = 0
            while done < times:
                n = min(r[0][1] for r in runs)
                offset = 0
                for r in runs:
                    length, have = r[0]
                    place(length, n, sequence, offset)
                    offset += length
                    r[0] = (length, have - n)
                    if have == n:
                        r.pop(0)
                rooms[capacity - offset].append((sequence, n))
                sequence, done = sequence + n, done + n

    # Small pieces, longest first, into the least room that holds them; a new sequence where none does.
    known = sorted(r for r in rooms if r)
    for length in sorted(small, reverse=True):
        n = small[length]
        while n:
            k = bisect_left(known, length)
            if k == len(known):
                new = -(-n // (capacity // length))
                _add(rooms, known, capacity, (sequence, new))
                sequence += new
                continue
            room = known[k]
            first, have = rooms[room].pop()
            m = min(n, have)
            place(length, m, first, capacity - room)
            n -= m
            if have > m:
                rooms[room].append((first + m, have - m))
            elif not rooms[room]:
                del rooms[room]
                known.pop(k)
            _add(rooms, known, room - length, (first, m))
    return slots


def _add(rooms: dict[int, list[tuple[int, int]]], known: list[int], room: int, stretch: tuple[int, int]) -> None:
    if room:
        if not rooms.get(room):
            insort(known, room)
        rooms[room].append(stretch)


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = 512, small_parts: int = 3) -> DataFrame:
    """The staged pieces with their sequence_id and offset."""
    spark = pieces.sparkSession
    per_chunk = materialise(pieces.groupBy("length", "chunk").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in per_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(
        plan_slots(counts, capacity, groups, small_parts), "length long, first long, n long, first_sequence long, offset long"
    )
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_chunk.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "chunk").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("_inside", F.row_number().over(inside)).join(broadcast_if_small(starts), ["length", "chunk"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_inside") - 1)
    s = slots.select(F.col("length").alias("_length"), "first", "n", "first_sequence", "offset")
    on = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("first") + F.col("n"))
    return ranked.join(broadcast_if_small(s), on).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.col("_rank") - F.col("first")).alias("sequence_id"), "offset",
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    return pack(token_pieces(docs, tokenizer, end_id, capacity), capacity)


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
