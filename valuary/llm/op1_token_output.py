"""Token-ID output: documents as separately compressed frames under one shared zstandard dictionary.

A token set is a folder with two Parquet tables that Spark's own writers commit, so a lost executor leaves
no half-written file and any store that Spark reaches can hold it:

* `dictionary`: one row, the zstandard dictionary and its hash;
* `blocks`: in ascending doc_id order, one row per block of neighbouring documents: shard and block number,
  dictionary hash, doc_ids, token counts, CRC-32 sums, byte offsets of the frames, and the payload, in which
  the document's little-endian 32-bit ids stand as one zstandard frame each.

The offset index gives any document's frame without touching its neighbours (`read_documents`). The dictionary
is trained on a bounded sample of serialised id arrays (`sample_docs` documents, `sample_bytes` of each); it
affects sizes only.

Defined results: a null or empty text is the end id alone; a null doc_id sorts first; repeated rows are written
one by one; extra columns are ignored; an empty table gives a set without blocks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from valuary.llm.registry import query, table
from valuary.llm.tokens import encoded
from valuary.session import scratch_path

BYTE_BPE = "byte_bpe_50k.json"
END_ID = 2
LEVEL = 3
BLOCK_BYTES = 1 << 20
BLOCKS = (
    "shard int, block int, dictionary string, doc_ids array<bigint>, n_tokens array<bigint>, "
    "crc32 array<bigint>, offsets array<bigint>, payload binary"
)


def train_dictionary(
    docs: DataFrame, tokenizer: str, end_id: int = END_ID, size: int = 64_000, sample_docs: int = 1000, sample_bytes: int = 16_384
) -> bytes:
    """A dictionary from the documents with the smallest hashes of their id; empty if the sample is too small."""
    import zstandard

    def serialise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids in encoded(batches, tokenizer, end_id):
            yield pa.RecordBatch.from_pydict({"ids": [a.tobytes()[:sample_bytes] for a in ids]}, pa.schema([("ids", pa.binary())]))

    chosen = docs.select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).select("text")
    samples = [bytes(r.ids) for r in chosen.mapInArrow(serialise, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(size, [s for s in samples if len(s) >= 8], threads=0).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_content_size=True)


def _decompressor(raw: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)


def write_token_set(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode every text and write the set; documents are dealt to shards by ranges of doc_id."""
    spark = docs.sparkSession
    raw = train_dictionary(docs, tokenizer, end_id)
    name = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(name, bytearray(raw))], "dictionary string, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block, held, press = TaskContext.get().partitionId(), 0, [], _compressor(raw)

        def row() -> pa.RecordBatch:
            frames = [h[3] for h in held]
            ends = np.cumsum([len(f) for f in frames])
            return pa.RecordBatch.from_pylist(
                [
                    {
                        "shard": shard, "block": block, "dictionary": name, "doc_ids": [h[0] for h in held],
                        "n_tokens": [h[1] for h in held], "crc32": [h[2] for h in held],
                        "offsets": [0, *ends.tolist()], "payload": b"".join(frames),
                    }
                ],
                schema,
            )

        size = 0
        for rows, ids in encoded(batches, tokenizer, end_id):
            for doc_id, a in zip(rows.column("doc_id").to_pylist(), ids):
                plain = a.astype("<u4").tobytes()
                held.append((doc_id, len(a), zlib.crc32(plain), press.compress(plain)))
                size += len(held[-1][3])
                if size >= BLOCK_BYTES:
                    yield row()
                    block, held, size = block + 1, [], 0
        if held:
            yield row()

    schema = pa.schema(
        [("shard", pa.int32()), ("block", pa.int32()), ("dictionary", pa.string())]
        + [(c, pa.list_(pa.int64())) for c in ("doc_ids", "n_tokens", "crc32", "offsets")]
        + [("payload", pa.binary())]
    )
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    return row["dictionary"], bytes(row["bytes"])


def read_documents(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """The documents of a set (all, or the few asked for): doc_id, shard, block, place, n_tokens, ids_crc32 and ids.

    Only the frames asked for are decompressed. A dictionary of another hash, a wrong length or checksum raises.
    """
    name, raw = _dictionary(spark, path)
    wanted = None if doc_ids is None else set(doc_ids)
    found = spark.read.parquet(f"{path}/blocks")
    if wanted is not None:
        found = found.where(F.arrays_overlap("doc_ids", F.array(*[F.lit(i).cast("long") for i in wanted])))
    out = "doc_id long, shard int, block int, place int, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def frames(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = _decompressor(raw)
        for batch in batches:
            for b in batch.to_pylist():
                if b["dictionary"] != name:
                    raise ValueError(f"block {b['shard']}/{b['block']} needs dictionary {b['dictionary']}")
                rows = []
                for i, doc_id in enumerate(b["doc_ids"]):
                    if wanted is None or doc_id in wanted:
                        plain = press.decompress(b["payload"][b["offsets"][i] : b["offsets"][i + 1]])
                        if len(plain) != 4 * b["n_tokens"][i] or zlib.crc32(plain) != b["crc32"][i]:
                            raise ValueError(f"block {b['shard']}/{b['block']}: document {doc_id} is damaged")
                        rows.append((doc_id, b["shard"], b["block"], i, len(plain) // 4, zlib.crc32(plain)))
                        if with_ids:
                            rows[-1] += (np.frombuffer(plain, "<u4").astype(np.int32),)
                if rows:
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                    names = ["doc_id", "shard", "block", "place", "n_tokens", "ids_crc32", "ids"]
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names[: len(cols)])

    return found.mapInArrow(frames, out)


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document what the files hold, and how many ids all documents before it have.

    Totals of blocks are added up inside each shard and totals of shards over all shards (one row a shard)."""
    found = read_documents(spark, path, with_ids=False)
    blocks = spark.read.parquet(f"{path}/blocks").select("shard", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
    shards = blocks.groupBy("shard").agg(F.sum("total").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shard_start = shards.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("_shard_start"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    block_start = blocks.select("shard", "block", F.coalesce(F.sum("total").over(inside), F.lit(0)).alias("_block_start"))
    starts = block_start.join(shard_start, "shard").select("shard", "block", (F.col("_shard_start") + F.col("_block_start")).alias("_start"))
    place = Window.partitionBy("shard", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return found.join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("_start") + F.coalesce(F.sum("n_tokens").over(place), F.lit(0))).alias("start"), "n_tokens", "ids_crc32"
    )


@query("op1_token_output")
def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-set")
    write_token_set(table(spark, sf_dir, "documents"), path, public_tokenizers.path(BYTE_BPE))
    return document_index(spark, path)
