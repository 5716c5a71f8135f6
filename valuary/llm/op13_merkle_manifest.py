"""Merkle manifest of a dataset: a leaf per row, a tree per source, a tree over the sources, a proof per row.

Leaves are numbered per source without a global window: rows are range-partitioned once, and offsets per
(source, partition) turn places within a partition into places within the source, so a source that holds most
rows is spread like all others. A tree of fan-out 3 is then climbed in blocks of 3^LEVELS neighbouring nodes. In
a block, level k works on the rows whose place is a multiple of 3^k: `lag` and `lead` at the fixed offsets 3^k and
2 * 3^k, masked by the slot in the run and by the run's length, give a node's siblings, and first-child rows
(slot 0) hash the parent. Six levels need one shuffle; the first rows of blocks are the nodes of the next climb.
On the way down each block adds its levels' siblings to the path of the block's node above.

Defined results: every column may be null (`-` in the leaf, the null source is a tree of its own and comes
first, a null doc_id comes first in its source and is never tampered with); an empty text is the value of
length 0; a very long text is only hashed once, no group of texts is formed; rows that share a doc_id follow
each other by leaf, equal rows get one proof each, in any order among themselves; further columns don't take
part and are not returned; an empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from valuary.llm import sql
from valuary.llm.registry import query, table
from valuary.session import lookup_join, stage_table

# The columns of a leaf in their order, and the children of a node.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FAN_OUT = 3
# Levels climbed within one shuffle: a block holds 3^6 = 729 nodes.
LEVELS = 6


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value), F.lit(":"), value), F.lit("-"))


def leaf_hash(**changed: Column) -> Column:
    return F.sha2(F.concat(*[encoded(changed.get(c, F.col(c))) for c in LEAF_COLUMNS]), 256)


def leaves(docs: DataFrame, tampered_text: Column | None = None) -> DataFrame:
    """Staged, one row per row of `docs`: tree (order-keeping key of the source), doc_id, leaf, changed_leaf."""
    leaf = leaf_hash()
    other = leaf if tampered_text is None else F.when(
        tampered_text.eqNullSafe(F.col("text")), leaf
    ).otherwise(leaf_hash(text=tampered_text))
    found = docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("tree"),
        "doc_id",
        leaf.alias("hash"),
        other.alias("changed"),
        F.monotonically_increasing_id().alias("row"),
    )
    return stage_table(found, "merkle-leaves")


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds pos (from 0, by `order`, which must be unique) and n, the number of nodes, per tree."""
    ranged = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = ranged.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    placed = stage_table(placed, "merkle-places")
    counts = placed.groupBy("tree", "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_count"))
    of_tree = Window.partitionBy("tree")
    before = F.sum("_count").over(of_tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(
        "tree", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_count").over(of_tree).alias("n")
    )
    joined = lookup_join(placed, offsets, ["tree", "_part"], "inner")
    return joined.withColumn("pos", F.col("_id") + F.col("_shift")).drop("_id", "_part", "_shift")


def at_level(level: int) -> str:
    """How many nodes a tree of n leaves has at a level."""
    return f"((n + {FAN_OUT**level - 1}) div {FAN_OUT**level})"


# Nodes of a block by place, and those up to the row itself.
BLOCK = "over (partition by tree, block order by pos)"
SO_FAR = "over (partition by tree, block order by pos rows between unbounded preceding and current row)"


def climbed(nodes: DataFrame, siblings: bool) -> DataFrame:
    """`nodes` (tree, pos, n, hash) with `block` and `top`, the block's own node, on the block's first row; with
    `siblings` also `path`, the (left, right) sibling digests of each row's ancestors below that node."""
    df = nodes.selectExpr("*", f"pos div {FAN_OUT**LEVELS} as block", "hash as top")
    for level in range(LEVELS):
        step = FAN_OUT**level
        lag1, lag2 = (f"lag(top, {k * step}) {BLOCK}" for k in (1, 2))
        lead1, lead2 = (f"lead(top, {k * step}) {BLOCK}" for k in (1, 2))
        slot = f"(pos div {step} % {FAN_OUT})"
        run = f"least({FAN_OUT}, {at_level(level)} - pos div {step} + {slot})"
        left = f"case {slot} when 0 then '' when 1 then {lag1} else concat({lag2}, {lag1}) end"
        right = f"concat(if({run} > {slot} + 1, {lead1}, ''), if({run} > {slot} + 2, {lead2}, ''))"
        parent = f"if({at_level(level)} > 1, sha2(concat(top, {right}), 256), top)"
        columns = {"top": F.expr(f"if(pos % {step * FAN_OUT} = 0, {parent}, null)")}
        if siblings:
            side = f"if(pos % {step} = 0, named_struct('left', {left}, 'right', {right}), null)"
            columns[f"_side{level}"] = F.expr(side)
        df = df.withColumns(columns)
    if siblings:
        sides = [f"if({at_level(k)} > 1, last_value(_side{k}) ignore nulls {SO_FAR}, null)" for k in range(LEVELS)]
        df = df.selectExpr(*nodes.columns, "block", "top", f"array_compact(array({', '.join(sides)})) as path")
    return df


def layers(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, and the staged nodes at the feet of each further climb; the last layer has one node a tree."""
    size, found = FAN_OUT**LEVELS, [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        firsts = climbed(found[-1].select("tree", "pos", "n", "hash"), siblings=False).where(F.col("pos") % size == 0)
        above = firsts.selectExpr("tree", "block as pos", f"{at_level(LEVELS)} as n", "top as hash")
        found.append(stage_table(above, "merkle-nodes"))
        most = -(-most // size)
    return found


def with_paths(found: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest layer with `path` up to its tree's node and on along `above`, which has a path and more per tree."""
    top = found[-1].join(above, "tree")
    for layer in reversed(found[:-1]):
        top = top.drop("n", "hash").withColumnsRenamed({"pos": "block", "path": "_path"})
        joined = climbed(layer, siblings=True).drop("top").join(top, ["tree", "block"])
        top = joined.withColumn("path", F.concat("path", "_path")).drop("_path", "block")
    return top


def folded(leaf: Column, path: Column) -> Column:
    """The digest that a leaf and its siblings give at the end of a path."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(docs: DataFrame, tampered_text: Column | None = None) -> DataFrame:
    """Per row of `docs`: tree, doc_id, leaf (`hash`), `changed` (the leaf with the tampered text), subroot, root
    and path, the (left, right) siblings of each level from the leaf to the root."""
    rows = layers(numbered(leaves(docs, tampered_text), ["doc_id", "hash", "row"]))
    subroots = rows[-1].select("tree", "hash")
    sources = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("member"), "hash"), ["member"])
    over = layers(sources)
    end = over[-1].select(
        "tree", F.col("hash").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path")
    )
    per_tree = with_paths(over, end).select(
        F.col("member").alias("tree"), F.col("hash").alias("subroot"), "root", "path"
    )
    return with_paths(rows, stage_table(per_tree, "merkle-sources"))


def without_newlines(docs: DataFrame) -> Column:
    """The tampering of the query: rows whose unsigned crc32 of the decimal doc_id is even lose their newlines."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(chosen, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


@query("op13_merkle_manifest", sql.MERKLE_MANIFEST)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    proved = manifest(docs, without_newlines(docs))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    again = folded(F.col("changed"), F.col("path"))
    return proved.select(
        "doc_id",
        F.col("hash").alias("leaf"),
        "subroot",
        "root",
        F.sha2(siblings, 256).alias("proof_sha256"),
        again.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
