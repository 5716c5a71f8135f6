"""Exact top-k search by distributed histogram selection.

Vectors are packed into blocks; every block of candidates meets every block of the stated query set by an
equi-join on the query block's number. A pass scores everything and counts, per query, into `BINS` bins of the
query's present score range; the counts of all tasks are summed. The bin that holds the k-th highest value becomes
the next range, until that range is one value wide or holds few rows. A last pass filters by it and ranks, ties to
the smaller vec_id.

A task only reports bins from that of its own k-th best upwards: the k-th best of all is no lower, so the sums down
to it stay exact, and a task sends at most about k bins a query. In the last pass it reports all rows above the range
and, of the rows inside it, its own best; rows of equal score (a third of all may be copies) are reported k at most.

Defined results: vectors null or with null or non-finite components take no part; candidates are of the query's
dimension; rows that share a vec_id are never each other's candidates, and their smallest vector is the query; a null
vec_id takes no part; scores beyond 64 bits are held at the limits of 64 bits; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from valuary.llm.registry import query, table
from valuary.session import broadcast_if_small, materialise, stage_table

BINS = 256
BLOCK = 1024
K = 5
LOW, HIGH = -(2**63), 2**63 - 1


def integer_vectors(vectors: DataFrame, factor: int = 256) -> DataFrame:
    """(vec_id, v): floor(factor * x) of every component, of the vectors that take part; v as doubles (whole numbers)."""
    x = F.col("embedding")
    sound = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    scaled = F.transform(x, lambda e: (F.lit(float(factor)) * e.cast("double")))
    # Whole doubles stay exact far beyond the range of long.
    down = F.transform(scaled, lambda e: F.when(F.abs(e) < 2.0**52, F.floor(e).cast("double")).otherwise(e))
    return vectors.where(F.col("vec_id").isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), down.alias("v"))


def blocks(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """Rows of up to `size` vectors of one dimension: dim, ids, matrix (doubles), largest (absolute component)."""
    schema = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("matrix", pa.binary()), ("largest", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            v = batch.column("v")
            ends = v.offsets.to_numpy()
            flat, dims = v.values.to_numpy(zero_copy_only=False), np.diff(ends)
            out = []
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                for part in np.split(rows, range(size, len(rows), size)):
                    m = np.stack([flat[ends[r] : ends[r + 1]] for r in part]) if dim else np.zeros((len(part), 0))
                    out.append((dim, ids[part].astype("<i8").tobytes(), m.astype("<f8").tobytes(), float(np.abs(m).max(initial=0.0))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return vectors.mapInArrow(run, "dim int, ids binary, matrix binary, largest double")


def scores(c: np.ndarray, q: np.ndarray, bound: float) -> np.ndarray:
    """Inner products, exact: in doubles below 2^53, in 64-bit integers below 2^63, in whole numbers of any size above."""
    if bound < 2.0**53:
        return (q @ c.T).astype(np.int64)
    if bound < 2.0**62:
        return q.astype(np.int64) @ c.T.astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(q) @ whole(c.T)
    return np.clip(exact, LOW, HIGH).astype(np.int64)


def _unpacked(row: dict, side: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{side}_ids"], "<i8")
    return ids, np.frombuffer(row[f"{side}_matrix"], "<f8").reshape(len(ids), row["dim"])


def _scored(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For every pair of blocks: query ids, candidate ids, scores, which pairs count, and the queries' lower and upper limits."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            (cid, c), (qid, q) = _unpacked(row, "c"), _unpacked(row, "q")
            s = scores(c, q, row["dim"] * row["c_largest"] * row["q_largest"])
            low, high = (np.frombuffer(row[f"q_{k}"], "<i8") for k in ("low", "high"))
            yield qid, cid, s, qid[:, None] != cid[None, :], low, high


def _bin_edges(low: int, high: int) -> int:
    """Width of a bin of the range [low, high]."""
    return max(1, -(-(high - low + 1) // BINS))


def count_bins(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, bin, n): scores in each bin of a query's range, bin BINS for those above it, from every task's k-th best upwards."""
    schema = pa.schema([("query_id", pa.int64()), ("bin", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qid, _, s, counts, low, high in _scored(batches):
            out = []
            for i, (a, b) in enumerate(zip(low.tolist(), high.tolist())):
                x = s[i][counts[i] & (s[i] >= a)]
                if len(x) > k:
                    x = x[x >= min(b, a + (min(int(np.partition(x, len(x) - k)[len(x) - k]), b) - a) // _bin_edges(a, b) * _bin_edges(a, b))]
                above = x > b
                # Differences fit 64 bits only as unsigned numbers.
                place = (x[~above].astype(np.uint64) - np.uint64(a % 2**64)) // np.uint64(_bin_edges(a, b))
                bins, n = np.unique(np.append(place.astype(np.int64), np.full(int(above.sum()), BINS)), return_counts=True)
                out += zip([int(qid[i])] * len(bins), bins.tolist(), n.tolist())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return pairs.mapInArrow(run, "query_id long, bin int, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))


def near_best(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): rows from the lower limit up, of each pair of blocks the best k of the query."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qid, cid, s, counts, low, _ in _scored(batches):
            out = []
            for i, a in enumerate(low.tolist()):
                at = np.flatnonzero(counts[i] & (s[i] >= a))
                at = at[np.lexsort((cid[at], ~s[i][at]))][:k] if len(at) > k else at
                out += zip([int(qid[i])] * len(at), cid[at].tolist(), s[i][at].tolist())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, max_passes: int = 12, enough: int = 4) -> DataFrame:
    """The k best candidates of `vectors` for every row of `queries` (both from `integer_vectors`).

    Ranges are refined until every query's range is one value or has at most `enough` times k rows in and above it.
    """
    spark = vectors.sparkSession
    candidates = stage_table(blocks(vectors), "candidate-blocks")
    one_each = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    number = Window.partitionBy("dim").orderBy("ids")
    asked = materialise(blocks(one_each).withColumn("block", F.row_number().over(number) - 1))
    # Score limits of a query block by its own and the candidates' largest components.
    largest = candidates.groupBy("dim").agg(F.max("largest").alias("c_most"), F.count("*").alias("n_blocks"))
    asked = asked.join(F.broadcast(materialise(largest)), "dim")
    limit = F.ceil(F.col("dim") * F.col("largest") * F.col("c_most")) + 1
    bounded = F.col("dim") * F.col("largest") * F.col("c_most") < 2.0**61
    ranges = asked.select(
        "dim",
        "block",
        F.explode(_unpack_ids(asked)).alias("query_id"),
        F.when(bounded, -limit).otherwise(F.lit(LOW)).alias("low"),
        F.when(bounded, limit).otherwise(F.lit(HIGH)).alias("high"),
        F.lit(False).alias("settled"),
    )
    ranges = materialise(ranges)
    per_dim = asked.groupBy("dim").agg(F.count("*").alias("n_asked"))
    spread = candidates.join(F.broadcast(per_dim), "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_asked").cast("int") - 1)))
    spread = spread.select("dim", "block", *[F.col(c).alias(f"c_{c}") for c in ("ids", "matrix", "largest")])

    def pairs(which: DataFrame) -> DataFrame:
        """Candidate blocks beside the query blocks, which hold the present ranges of their queries."""
        limits = which.groupBy("dim", "block").agg(F.sort_array(F.collect_list(F.struct("query_id", "low", "high"))).alias("limits"))
        side = asked.join(limits, ["dim", "block"]).select(
            "dim", "block", *[F.col(c).alias(f"q_{c}") for c in ("ids", "matrix", "largest")], "limits"
        )
        packed = materialise(side.mapInArrow(_with_limits, "dim int, block int, q_ids binary, q_matrix binary, q_largest double, q_low binary, q_high binary"))
        return spread.join(broadcast_if_small(packed, 64), ["dim", "block"])

    for _ in range(max_passes):
        still = ranges.where(~F.col("settled"))
        if still.isEmpty():
            break
        counted = count_bins(pairs(still), k)
        down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        summed = counted.withColumn("upto", F.sum("n").over(down))
        # The bin of the k-th value; a query with fewer than k candidates takes its lowest.
        hit = summed.groupBy("query_id").agg(
            F.max(F.when(F.col("upto") >= k, F.struct("bin", "upto"))).alias("kth"), F.min("bin").alias("lowest")
        )
        # Ranges of 64-bit numbers are wider than 64 bits.
        low, high = (F.col(c).cast("decimal(38,0)") for c in ("low", "high"))
        width = F.greatest(F.lit(1), F.ceil((high - low + 1) / F.lit(BINS))).cast("decimal(38,0)")
        found = still.join(hit, "query_id", "left")
        bin_ = F.col("kth.bin").cast("decimal(38,0)")
        start = low + bin_ * F.col("_width")
        found = found.withColumn("_width", width).select(
            "dim", "block", "query_id",
            F.when(bin_.isNull(), F.col("low")).otherwise(start.cast("long")).alias("low"),
            F.when(bin_.isNull(), F.col("high")).otherwise(F.least(start + F.col("_width") - 1, high).cast("long")).alias("high"),
            (bin_.isNull() | (F.col("_width") == 1) | (F.col("kth.upto") <= enough * k)).alias("settled"),
        )
        ranges = materialise(ranges.where("settled").unionByName(found))
    best = near_best(pairs(ranges), k)
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _unpack_ids(asked: DataFrame):
    """Ids of a query block as an array column."""

    @F.pandas_udf("array<bigint>")
    def ids(raw):
        return raw.map(lambda b: np.frombuffer(b, "<i8"))

    return ids(asked["ids"])


def _with_limits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Query blocks cut down to the queries that have limits, with these as arrays in the order of their ids."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            ids = np.frombuffer(r["q_ids"], "<i8")
            matrix = np.frombuffer(r["q_matrix"], "<f8").reshape(len(ids), r["dim"])
            limits = {x["query_id"]: (x["low"], x["high"]) for x in r["limits"]}
            mine = np.array([i for i, x in enumerate(ids.tolist()) if x in limits], np.int64)
            low, high = (np.array([limits[x][j] for x in ids[mine].tolist()], "<i8") for j in (0, 1))
            rows.append((r["dim"], r["block"], ids[mine].tobytes(), matrix[mine].tobytes(), r["q_largest"], low.tobytes(), high.tobytes()))
        if rows:
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.float64(), pa.binary(), pa.binary()]
            names = ["dim", "block", "q_ids", "q_matrix", "q_largest", "q_low", "q_high"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


SQL_TOP_K = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id,
    cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
) where rank <= {K}
"""


@query("op2_exact_top_k", SQL_TOP_K)
def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))
