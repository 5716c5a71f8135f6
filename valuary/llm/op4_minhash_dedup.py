"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

1. One pass over the texts: words, distinct shingles as 64-bit hashes, a fingerprint of the whole set, and a
   signature. Two permutations make all its coordinates: the first one scatters shingles over a circle of D
   places, the second one ranks the places and is shifted by one place for each further coordinate. Coordinates are
   hashed in `BANDS` bands of `ROWS`; at a similarity of 0.8 a pair misses all of them with probability 5e-8.
2. Documents with equal sets become one class at once, however many they are; only its smallest doc_id goes on, as
   `node`. `part` is the hash of one of its texts, the smallest one: a doc_id with different sets has a class for each.
3. In each bucket of a band, the smallest member (the hub) is compared with the others: one pair a member, not
   all pairs. Pairs are confirmed on the full sets of the texts; links give components.
4. Buckets that still hold several components are settled exactly by a prefix filter. The shingles of the documents in
   them are ordered from the rarest to the most common; two sets that reach the similarity share a shingle near the
   head of both, and the places of the first shared one bound what they can have in common. Only pairs from different
   components within that bound count, long lists are dealt out in slices, and most pairs fall in the join already, by
   their marks (below). One pair per document and other component is confirmed first, then those still apart.

`marks` are the parities of a set's shingles in 512 places: places that differ between two sets are at least as many
shingles that differ, which bounds the similarity from above. No pair of texts travels before it has passed that.

Defined results: a null or empty text, or one without words, has no shingles and no links; rows of one doc_id
are one document, linked if any of their texts are; a null doc_id has no component, is kept and links nothing;
repeated rows are returned as often as they come; ties need no order, for links are symmetric; extra columns are
ignored; an empty table gives an empty result. Of a very long text only one set is held at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valuary.llm import sql
from valuary.llm.components import connected_components
from valuary.llm.registry import query, table
from valuary.llm.words import chunks
from valuary.session import broadcast_if_small, drop_folder, materialise, scratch_path, stage_table

BANDS, ROWS = 32, 4
CIRCLE = 1 << 20
SEED = 20240607
MARKS = 8  # words of 64 places
KEPT_WORDS = 100_000  # hashes of words that a worker keeps
LIST = 512  # rows of a list of shingle holders in one slice
PAIR = ("a", "a_part", "b", "b_part")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class _WordHashes(dict):
    """64-bit hashes of words, kept for the worker and emptied when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; the whole sequence is one if it is shorter than a shingle."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(size, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = (out + h[i : len(h) - width + 1 + i]) * _MULTIPLIER
        out ^= out >> np.uint64(29)
    out *= _MIX
    out ^= out >> np.uint64(32)
    return np.unique(out)


@lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and the ranking one continued past its end by the number of shifts."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    scatter = rng.permutation(CIRCLE).astype(np.int32)
    ranking = rng.permutation(CIRCLE).astype(np.int32)
    return scatter, np.concatenate([ranking, ranking[: BANDS * ROWS]])


def band_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BANDS hashes per non-empty set, by circulant MinHash."""
    scatter, ranking = _permutations()
    flat = np.concatenate(sets)
    place = scatter[(flat & np.uint64(CIRCLE - 1)).astype(np.int64)]
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    bands = np.full((len(sets), BANDS), SEED, np.uint64)
    for k in range(BANDS * ROWS):
        low = np.minimum.reduceat(ranking[place + k], starts).astype(np.uint64)
        band = bands[:, k // ROWS]
        band[:] = (band ^ low) * _MULTIPLIER
        band ^= band >> np.uint64(31)
    return bands


def parity_marks(sets: list[np.ndarray]) -> np.ndarray:
    """One row of MARKS words per set: in each of 64 * MARKS places, the parity of the number of its shingles there."""
    places = 64 * MARKS
    out = []
    # Some sets at a time: short texts are many, and the counts take 4 KB a set.
    for start in range(0, len(sets), 2048):
        some = sets[start : start + 2048]
        owner = np.repeat(np.arange(len(some)), [len(s) for s in some])
        place = (np.concatenate(some) >> np.uint64(32)).astype(np.int64) % places
        odd = np.bincount(owner * places + place, minlength=len(some) * places) & 1
        out.append(np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(some), MARKS))
    return np.concatenate(out)


def can_reach(x: str, y: str, percent: int) -> tuple[Column, Column]:
    """For two sets with columns `<x>n`, `<x>marks` and `<y>n`, `<y>marks`: how many shingles differ at least, and whether
    sizes and marks allow the similarity."""
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    apart = sum(F.bit_count(F.col(f"{x}marks")[i].bitwiseXOR(F.col(f"{y}marks")[i])) for i in range(MARKS))
    sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return apart, sizes & ((100 + percent) * apart <= (100 - percent) * (n + m))


def signatures(docs: DataFrame, size: int, folder: str | None = None) -> DataFrame:
    """Staged per row: doc_id, part (hash of the text), n_shingles, the set's fingerprint (null if empty), its band hashes
    and marks."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("part", pa.int64()),
            ("n_shingles", pa.int64()),
            ("print", pa.binary()),
            ("bands", pa.list_(pa.int64())),
            ("marks", pa.list_(pa.int64())),
        ]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches, 2_000_000):
            sets = [shingles(t, size) for t in texts]
            full = [s for s in sets if len(s)]
            hashed = iter(band_hashes(full).astype(np.int64) if full else ())
            marked = iter(parity_marks(full) if full else ())
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    rows.column("part"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(hashed) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    pa.array([next(marked) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                schema=schema,
            )

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("part"), "text")
    columns = "doc_id long, part long, n_shingles long, print binary, bands array<long>, marks array<long>"
    return stage_table(ids.mapInArrow(run, columns), "signatures", folder)


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The nodes (a, b) of the pairs (a, a_part, b, b_part) whose full sets reach the similarity, by the texts of both."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            sets = zip(a, batch.column("a_part").to_pylist())
            keep = []
            for i, (x, left, right) in enumerate(zip(sets, batch.column("text_a"), batch.column("text_b"))):
                if x != last:
                    last, mine = x, shingles(left.as_py(), size)
                other = shingles(right.as_py(), size)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(other) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_pydict({"a": [a[i] for i in keep], "b": [b[i] for i in keep]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    side = lambda c: texts.select(F.col("node").alias(c), F.col("part").alias(f"{c}_part"), F.col("text").alias(f"text_{c}"))
    both = pairs.join(side("b"), ["b", "b_part"]).join(side("a"), ["a", "a_part"])
    return both.select("a", "a_part", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def close_pairs(texts: DataFrame, sets: DataFrame, size: int, percent: int, folder: str | None = None) -> DataFrame:
    """Pairs (a, a_part, b, b_part, apart) of `sets` (node, part, n, marks, component; `texts` holds the text of each), from
    different components, that can reach the similarity: no other pair of different components does."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = zip(batch.column("node").to_pylist(), batch.column("part").to_pylist())
            for (node, part), text in zip(ids, batch.column("text")):
                s = shingles(text.as_py(), size).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(s), node)), pa.array(np.full(len(s), part)), pa.array(s)], ["node", "part", "shingle"]
                )

    texts = texts.join(sets.select("node", "part"), ["node", "part"], "left_semi").select("node", "part", "text")
    each = stage_table(texts.mapInArrow(run, "node long, part long, shingle long"), "open-shingles", folder)
    shared = each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    ordered = each.join(shared, "shingle").groupBy("node", "part").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("shared"))
    # Shingles that stand nowhere else are the rarest: they take the first places, and need no list.
    ordered = ordered.join(sets, ["node", "part"]).withColumn("alone", F.col("n") - F.size("shared"))
    head = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("alone")
    held = ordered.where(head > 0).select(
        "node", "part", "n", "marks", "component", "alone", F.posexplode(F.slice("shared", F.lit(1), head.cast("int"))).alias("i", "s")
    )
    held = stage_table(held.select("node", "part", "n", "marks", "component", (F.col("alone") + F.col("i")).alias("place"), "s.shingle"), "heads", folder)
    lists = held.groupBy("shingle").agg(F.count("*").alias("held"), F.min("component").alias("low"), F.max("component").alias("high"))
    lists = lists.where("low < high").select("shingle", F.ceil(F.col("held") / LIST).cast("int").alias("slices"))
    held = materialise(held.join(lists, "shingle"))
    side = lambda c, df: df.select("shingle", "slice", *[F.col(x).alias(f"{c}_{x}") for x in ("node", "part", "n", "marks", "component", "place")])
    left = side("a", held.withColumn("slice", F.pmod(F.xxhash64("node", "part"), F.col("slices")).cast("int")))
    right = side("b", held.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))))
    # Everything that both share stands at these places or behind.
    most = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place"))
    apart, can = can_reach("a_", "b_", percent)
    apart_now = (F.col("a_node") < F.col("b_node")) & (F.col("a_component") != F.col("b_component"))
    pairs = left.join(right, ["shingle", "slice"]).where(apart_now & ((100 + percent) * most >= percent * (F.col("a_n") + F.col("b_n"))) & can)
    return pairs.select(F.col("a_node").alias("a"), "a_part", F.col("b_node").alias("b"), "b_part", apart.alias("apart")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, folder: str | None = None) -> DataFrame:
    """Per row of `docs` (doc_id, text): n_shingles, component_id and kept.

    With a `folder` all staged tables lie in it; the result reads one of them."""
    rows = signatures(docs, size, folder)
    usable = rows.where(F.col("print").isNotNull() & F.col("doc_id").isNotNull())
    classes = materialise(
        usable.groupBy("print").agg(
            F.min(F.struct("doc_id", "part")).alias("least"),
            F.first("n_shingles").alias("n"),
            F.first("bands").alias("bands"),
            F.first("marks").alias("marks"),
            F.count("*").alias("copies"),
        )
        .select("print", F.col("least.doc_id").alias("node"), "least.part", "n", "bands", "marks", "copies")
    )
    # Members of buckets: one row per class and band, only where a bucket has two classes or more.
    members = classes.select("node", "part", "n", F.posexplode("bands").alias("band", "hash"))
    buckets = members.groupBy("band", "hash").agg(F.min("node").alias("hub"), F.count("*").alias("size")).where("size > 1")
    members = stage_table(members.join(buckets, ["band", "hash"]).select("band", "hash", "node", "part", "n", "hub", "size"), "buckets", folder)
    # The hub is the smallest part of the smallest node; its other parts are linked to it anyway, as one doc_id.
    hubs = members.where("node = hub").groupBy("band", "hash").agg(F.min("part").alias("a_part"))
    star = members.where("node != hub").join(hubs, ["band", "hash"])
    star = star.select(F.col("hub").alias("a"), "a_part", F.col("node").alias("b"), F.col("part").alias("b_part")).distinct()
    side = lambda c: classes.select(F.col("node").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in ("part", "n", "marks")])
    star = star.join(side("a"), ["a", "a_part"]).join(side("b"), ["b", "b_part"]).where(can_reach("a_", "b_", percent)[1])
    star = materialise(star.select(*PAIR))

    # One text for each class that is in any bucket with others; only classes of several rows can hold it repeatedly.
    active = members.select("node", "part").distinct().join(classes.select("node", "part", "copies"), ["node", "part"])
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("node"), F.xxhash64("text").alias("part"), "text")
    texts = texts.join(broadcast_if_small(materialise(active), 1_000_000), ["node", "part"])
    texts = texts.where("copies = 1").union(texts.where("copies > 1").dropDuplicates(["node", "part"])).drop("copies")
    texts = stage_table(texts, "bucket-texts", folder)

    # Copies of a set belong to its class; so do all sets of one doc_id.
    same = classes.select("print", "node")
    own = usable.join(same, "print").where("doc_id != node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    links = materialise(verify(star, texts, size, percent).union(own.distinct()))
    components = _settle(members.where("size > 2"), classes, links, star, texts, size, percent, folder)
    found = rows.select("doc_id", "n_shingles").join(components, F.col("doc_id") == F.col("node"), "left")
    return found.select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _settle(
    members: DataFrame, classes: DataFrame, links: DataFrame, tried: DataFrame, texts: DataFrame, size: int, percent: int, folder: str | None
) -> DataFrame:
    """Components of the links and of those that hubs could not show: between members of one bucket."""
    components = connected_components(links)
    placed = members.select("band", "hash", "node", "part").join(components, "node", "left")
    placed = materialise(placed.withColumn("component", F.coalesce("component", "node")))
    mixed = placed.groupBy("band", "hash").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    open_ = placed.join(mixed, ["band", "hash"], "left_semi").groupBy("node", "part").agg(F.first("component").alias("component"))
    open_ = materialise(open_.join(classes.select("node", "part", "n", "marks"), ["node", "part"]))
    if open_.isEmpty():
        return components
    pairs = materialise(close_pairs(texts, open_, size, percent, folder).join(tried, list(PAIR), "left_anti"))
    # Most pairs lie between the same few components: the nearest one of a document in each other component goes first.
    of = lambda c: components.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    named = pairs.join(of("b"), "b", "left").withColumn("b_component", F.coalesce("b_component", "b"))
    first = named.groupBy("a", "a_part", "b_component").agg(F.min(F.struct("apart", "b", "b_part")).alias("_least"))
    first = materialise(first.select("a", "a_part", "_least.b", "_least.b_part"))
    links = links.union(materialise(verify(first, texts, size, percent)))
    components = connected_components(links)
    rest = pairs.join(first, list(PAIR), "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    rest = rest.where(F.coalesce("a_component", "a") != F.coalesce("b_component", "b"))
    found = materialise(verify(rest.select(*PAIR), texts, size, percent))
    return components if found.isEmpty() else connected_components(links.union(found))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one document of each group: rows of doc_ids that another one stands for go.

    Of the rows of a doc_id that stays, the smallest one stays: by text (null last), then by the other columns in
    their order, which must be of types that have one (no maps).
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "near-duplicates")
    judged = near_duplicates(docs, size, percent, folder)
    gone = materialise(judged.where(~F.col("kept")).select("doc_id").distinct())
    # The ids stand by themselves now: texts and signatures that were staged for them needn't stay as long as the result.
    drop_folder(spark, folder)
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct(F.col("text").isNull().alias("_no_text"), "text", *rest)
    unique = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(row).alias("_row")).select("doc_id", "_row.*")
    unique = unique.join(broadcast_if_small(gone, 1_000_000), "doc_id", "left_anti").select(docs.columns)
    return unique.union(docs.where(F.col("doc_id").isNull()))


@query("op4_minhash_dedup", sql.NEAR_DUPLICATES)
def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4)
