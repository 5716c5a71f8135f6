"""Removal of repeated passages by super-k-mer partitioning.

A window is `WINDOW` consecutive words of a document. Every window has a minimiser, the smallest hash among its
runs of `SEED_WORDS` words; consecutive windows with the same minimiser travel as one packed string of words (a
super-k-mer) to the bucket that the minimiser names, so equal windows meet in one bucket. There they are cut out
again and sorted by a 128-bit hash; a window is repeated where a smaller doc_id holds it too. The positions
go back to their documents, which drop all words under such windows.

Before anything travels, windows that a chunk of documents holds more than once are settled inside the chunk: only
those of its smallest doc_id go on, so a passage or a copied document that fills a third of the corpus reaches its
bucket once a chunk. The super-k-mers of a chunk and bucket are one compressed row. The number of buckets follows
the size of the input; a bucket that is still large is sorted in slices of its hashes.

Defined results: a null or empty text has no words and keeps none; rows with one doc_id never repeat one another;
a null doc_id counts as larger than every other; repeated rows are returned as often as they come; extra columns
are carried only by `without_repeats`; an empty table gives an empty result; a very long text is cut into the
super-k-mers of all its windows like any other, in a chunk of its own.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuary.llm import sql
from valuary.llm.registry import query, table
from valuary.llm.words import Codes, byte_hashes, chunks, gather, word_bounds
from valuary.session import lookup_join

WINDOW = 13
SEED_WORDS = 2
CHUNK_TEXT = 5_000_000
WINDOWS_PER_BUCKET = 1_500_000
SLICE = 3_000_000
HASHED_TEXT = 1_000_000
LAST = np.iinfo(np.int64).max
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(left: np.ndarray, right: np.ndarray, multiplier: np.uint64) -> np.ndarray:
    out = left * multiplier
    out += right
    out ^= out >> np.uint64(31)
    return out


def _runs(h: np.ndarray, width: int, multiplier: np.uint64) -> np.ndarray:
    """Hash of every run of `width` values, put together from runs of 1, 2, 4, ... values."""
    n = max(0, len(h) - width + 1)
    out, have, part, size = None, 0, h, 1
    while size <= width:
        if width & size:
            out = part[:n] if out is None else _mixed(out[:n], part[have : have + n], multiplier)
            have += size
        if 2 * size <= width:
            m = max(0, len(part) - size)
            part = _mixed(part[:m], part[size : size + m], multiplier)
        size *= 2
    return out


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        h = np.minimum(h[:-have], h[have:]) if len(h) > have else h[:0]
        have *= 2
    if have < width:
        step = width - have
        h = np.minimum(h[:-step], h[step:]) if len(h) > step else h[:0]
    return h


def _equals(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows whose hashes others have too, side by side; where each group of equals begins there, and its size."""
    order = np.argsort(h1)
    a = h1[order]
    twin = np.flatnonzero(a[1:] == a[:-1])
    member = np.zeros(len(a), bool)
    member[twin] = True
    member[twin + 1] = True
    rows = order[member]
    a, b = a[member], h2[rows]
    new = np.ones(len(rows), bool)
    new[1:] = a[1:] != a[:-1]
    if ((b[1:] != b[:-1]) & ~new[1:]).any():
        # Two different windows share the first hash.
        again = np.lexsort((b, a))
        rows, a, b = rows[again], a[again], b[again]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    heads = np.flatnonzero(new)
    return rows, heads, np.diff(np.append(heads, len(rows)))


def _repeated(h1: np.ndarray, h2: np.ndarray, row: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The windows that a smaller doc holds too; `row` says which of the `doc` a window is of."""
    rows, heads, sizes = _equals(h1, h2)
    if not len(rows):
        return rows
    docs = doc[row[rows]]
    return rows[docs > np.repeat(np.minimum.reduceat(docs, heads), sizes)]


def _removal_rows(doc: np.ndarray, key: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """Rows (doc_id, key, spans), a document at a time; spans are pairs (first window start, how many in a row)."""
    if not len(doc):
        return
    order = np.lexsort((start, key, doc))
    doc, key, start = doc[order], key[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(key) != 0)
    heads = np.flatnonzero(np.append(True, new[1:] | (np.diff(start) != 1)))
    spans = np.column_stack([start[heads], np.diff(np.append(heads, len(start)))]).astype("<i4").tobytes()
    first = np.flatnonzero(new)
    cut = (8 * np.append(np.searchsorted(heads, first), len(heads))).tolist()
    for d, k, a, b in zip(doc[first].tolist(), key[first].tolist(), cut, cut[1:]):
        yield d, k, spans[a:b]


def pack(doc: np.ndarray, key: np.ndarray, start: np.ndarray, windows: np.ndarray, codes: np.ndarray, words: list[bytes], press) -> bytes:
    """Super-k-mers as one compressed string: their documents (in ascending order), places and words. `codes` number
    the `words`, which may be several words each."""
    text = b" ".join([words[c] for c in codes.tolist()])
    head = struct.pack("<q", len(doc))
    parts = [np.diff(doc, prepend=0).astype("<i8"), key.astype("<i8"), start.astype("<u4"), windows.astype("<u4")]
    return press.compress(head + b"".join(p.tobytes() for p in parts) + text)


def _unpacked(blob: bytes, press) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    raw = press.decompress(blob)
    (n,) = struct.unpack_from("<q", raw)
    at, out = 8, []
    for kind in ("<i8", "<i8", "<u4", "<u4"):
        out.append(np.frombuffer(raw, kind, n, at).astype(np.int64))
        at += n * np.dtype(kind).itemsize
    return np.cumsum(out[0]), *out[1:], raw[at:]


def unpack(blob: bytes, press) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    *places, text = _unpacked(blob, press)
    vocabulary = Codes()
    codes = np.fromiter(map(vocabulary.__getitem__, text.split()), np.int64)
    return *places, codes, list(vocabulary)


def _joined(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words in one string, where each starts and ends in it, and how many each text has. Long stretches of
    blanks become short."""
    raw = b"\n" + b"\n".join(texts) + b"\n" * 9
    data = np.frombuffer(raw, np.uint8)
    starts, ends = word_bounds(data)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    lengths = np.diff(np.searchsorted(starts, np.append(1, 1 + np.cumsum(sizes + 1))))
    if len(data) - (ends - starts).sum() > 2 * len(starts) + len(texts) + 10:
        raw = b"\n" + b" ".join(raw.split()) + b"\n" * 9
        starts, ends = word_bounds(np.frombuffer(raw, np.uint8))
    return raw, starts, ends, lengths


def super_kmers(docs: DataFrame, buckets: int, window: int) -> DataFrame:
    """Rows to deal out: (bucket, blob) with super-k-mers, or (bucket, doc_id, key, spans) settled inside a chunk."""
    schema = pa.schema([("bucket", pa.int64()), ("blob", pa.binary()), ("doc_id", pa.int64()), ("key", pa.int64()), ("spans", pa.binary()), ("size", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for rows, texts in chunks(batches, CHUNK_TEXT):
            ids = np.array([LAST if i is None else i for i in rows.column("doc_id").to_pylist()], np.int64)
            by_id = np.argsort(ids, kind="stable")
            ids, keys = ids[by_id], np.array(rows.column("key").to_pylist(), np.int64)[by_id]
            raw, starts, ends, lengths = _joined([texts[i].encode() for i in by_id.tolist()])
            n_windows = np.maximum(lengths - window + 1, 0)
            if not n_windows.any():
                continue
            h1, h2 = byte_hashes(np.frombuffer(raw, np.uint8), starts, ends)
            first = np.cumsum(lengths) - lengths
            begin = gather(np.arange(len(starts)), first, n_windows)
            of = np.repeat(np.arange(len(ids), dtype=np.int32), n_windows)
            w1, w2 = _runs(h1, window, _MULTIPLIER)[begin], _runs(h2, window, _OTHER)[begin]
            least = _sliding_min(_runs(h1, SEED_WORDS, _OTHER), window - SEED_WORDS + 1)[begin]
            del h1, h2
            repeated = np.zeros(len(begin), bool)
            repeated[_repeated(w1, w2, of, ids)] = True
            del w1, w2
            gone, start_of = of[repeated], begin - first[of]
            out = [((d ^ k) % buckets, None, d, k, s, 0) for d, k, s in _removal_rows(ids[gone], keys[gone], start_of[repeated])]
            # Runs of windows that go on, stand side by side and share a minimiser.
            go = np.flatnonzero(~repeated)
            if len(go):
                new = np.ones(len(go), bool)
                new[1:] = (np.diff(begin[go]) != 1) | (np.diff(of[go]) != 0) | (least[go][1:] != least[go][:-1])
                heads = np.flatnonzero(new)
                windows = np.diff(np.append(heads, len(go)))
                at = go[heads]
                bucket = (least[at] % np.uint64(buckets)).astype(np.int64)
                by_bucket = np.argsort(bucket, kind="stable")
                at, windows, bucket = at[by_bucket], windows[by_bucket], bucket[by_bucket]
                last = ends[begin[at] + windows + window - 2].tolist()
                pieces = [raw[i:j] for i, j in zip(starts[begin[at]].tolist(), last)]
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                for part in np.split(np.arange(len(at)), cuts):
                    a, n = at[part], windows[part]
                    blob = pack(ids[of[a]], keys[of[a]], start_of[a], n, part, pieces, press)
                    out.append((int(bucket[part[0]]), blob, None, None, None, int(n.sum())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return docs.mapInArrow(run, "bucket long, blob binary, doc_id long, key long, spans binary, size long")


def _windows(blobs: list[bytes], window: int, part: int, parts: int) -> list[np.ndarray]:
    """(hash, other hash, super-k-mer, start) of all windows in the blobs whose hash falls into the slice, and (doc, key)
    of the super-k-mers. Blobs are hashed together up to `HASHED_TEXT` bytes."""
    import zstandard

    press, found, places, before = zstandard.ZstdDecompressor(), [], [], 0

    def hashed(held: list[tuple]) -> None:
        nonlocal before
        doc, key, start, n = (np.concatenate(x) for x in list(zip(*held))[:4])
        data = np.frombuffer(b"".join([b" ", b" ".join([h[4] for h in held]), b" " * 9]), np.uint8)
        h1, h2 = byte_hashes(data, *word_bounds(data))
        first = np.cumsum(n + window - 1) - (n + window - 1)
        begin = gather(np.arange(len(h1)), first, n)
        row = np.repeat(np.arange(len(n)), n)
        each = [_runs(h1, window, _MULTIPLIER)[begin], _runs(h2, window, _OTHER)[begin], (before + row).astype(np.int32), start[row] + begin - first[row]]
        each[3] = each[3].astype(np.int32)
        if parts > 1:
            mine = each[0] % np.uint64(parts) == part
            each = [x[mine] for x in each]
        found.append(each)
        places.append((doc, key))
        before += len(n)

    held, size = [], 0
    for blob in blobs:
        held.append(_unpacked(blob, press))
        size += len(held[-1][4])
        if size >= HASHED_TEXT:
            hashed(held)
            held, size = [], 0
    if held:
        hashed(held)
    return [np.concatenate(x) for x in (*zip(*found), *zip(*places))]


def repeated_windows(dealt: DataFrame, window: int) -> DataFrame:
    """(doc_id, key, spans) of the windows that a smaller doc_id holds too, from rows that lie bucket by bucket."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("spans", pa.binary())])

    def settle(blobs: list[bytes], size: int) -> Iterator[pa.RecordBatch]:
        parts = -(-size // SLICE)
        for part in range(parts):
            w1, w2, row, start, doc, key = _windows(blobs, window, part, parts)
            hit = _repeated(w1, w2, row, doc)
            out = [*_removal_rows(doc[row[hit]], key[row[hit]], start[hit])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs, size = None, [], 0
        for batch in batches:
            settled = batch.filter(pa.compute.is_valid(batch.column("spans")))
            if settled.num_rows:
                yield settled.select(["doc_id", "key", "spans"])
            for b, blob, n in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), batch.column("size").to_pylist()):
                if blob is None:
                    continue
                if b != bucket and blobs:
                    yield from settle(blobs, size)
                    blobs, size = [], 0
                bucket = b
                blobs.append(blob)
                size += n
        if blobs:
            yield from settle(blobs, size)

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc_id long, key long, spans binary")


def bucket_count(docs: DataFrame) -> int:
    """Buckets of about `WINDOWS_PER_BUCKET` windows, and at least two for each shuffle partition."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // (6 * WINDOWS_PER_BUCKET))


def covered(n_words: int, spans: Iterable[bytes], window: int) -> np.ndarray:
    """Which words lie under the windows."""
    edge = np.zeros(n_words + 1, np.int64)
    for raw in spans:
        s = np.frombuffer(raw, "<i4").reshape(-1, 2).astype(np.int64)
        np.add.at(edge, s[:, 0], 1)
        np.add.at(edge, s[:, 0] + s[:, 1] + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def with_spans(docs: DataFrame, window: int, *extra: str) -> DataFrame:
    """doc_id, text, the extra columns, and the repeated windows of every row of `docs`.

    Rows of one doc_id with different texts are told apart by `key`, the text's 64-bit hash; a doc_id that stands
    once, as nearly all do, has key 0, which takes no room on the way."""
    one_id = F.coalesce("doc_id", F.lit(int(LAST))).alias("_id")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), one_id, *extra)
    # Only ids travel here: those that more than one row has.
    several = docs.groupBy(one_id).agg(F.count("*").alias("_n")).where("_n > 1").select("_id", F.lit(True).alias("_several"))
    keyed = lookup_join(texts, several, ["_id"])
    keyed = keyed.withColumn("key", F.when(F.col("_several"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))).drop("_id", "_several")
    found = repeated_windows(super_kmers(keyed.select("doc_id", "text", "key"), bucket_count(keyed), window), window)
    per_doc = found.groupBy("doc_id", "key").agg(F.collect_list("spans").alias("spans"))
    keyed = keyed.withColumn("_id", F.coalesce("doc_id", F.lit(int(LAST))))
    return keyed.join(per_doc.withColumnRenamed("doc_id", "_id"), ["_id", "key"], "left").drop("_id", "key")


def substring_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_removed, kept_sha256."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            out = []
            for doc_id, text, spans in zip(rows.column("doc_id").to_pylist(), texts, rows.column("spans").to_pylist()):
                words = text.encode().split()
                gone = covered(len(words), spans or (), window)
                kept = [w for w, g in zip(words, gone.tolist()) if not g] if spans else words
                out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return with_spans(docs, window).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` with repeated passages cut out: the kept words joined by one blank where any word went, the text as it
    was (null stays null) elsewhere. Rows that lose all their words go; `n_chars`, where there is one, follows the
    text. The texts are shuffled once; all other columns go along, whatever their names."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, stays = [], []
            for text, spans, null in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "_null"))):
                if spans:
                    words = text.encode().split()
                    gone = covered(len(words), spans, window).tolist()
                    text = b" ".join([w for w, g in zip(words, gone) if not g]).decode()
                stays.append(not spans or text != "")
                texts.append(None if null else text)
            out = batch.select(["_rest"]).append_column("text", pa.array(texts, pa.string()))
            yield out.append_column("_cut", batch.column("spans").is_valid()).filter(pa.array(stays, pa.bool_()))

    names = docs.columns
    others = [F.col(f"`{c}`") for c in names if c != "text"]
    rows = docs.select("doc_id", "text", F.struct(*others).alias("_rest"), F.col("text").isNull().alias("_null"))
    found = with_spans(rows, window, "_rest", "_null").select("text", "spans", "_rest", "_null")
    kept = found.mapInArrow(cut, f"_rest {found.schema['_rest'].dataType.simpleString()}, text string, _cut boolean")
    columns = [
        F.col("text") if c == "text"
        else F.when(F.col("_cut"), F.char_length("text").cast(docs.schema[c].dataType)).otherwise(F.col(f"_rest.`{c}`")).alias(c) if c == "n_chars"
        else F.col(f"_rest.`{c}`").alias(c)
        for c in names
    ]
    return kept.select(*columns)


@query("op8_substring_dedup", sql.SUBSTRING_DEDUP)
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digest(table(spark, sf_dir, "documents"))
