"""Scans of sales, coordinates and training tables, chosen by name, with lineage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuary.functions.parse import day_of, number_of
from valuary.schemas import LATEST_SALES_COLUMNS, TRAINING_COLUMNS
from valuary.session import broadcast_if_small, lookup_join, materialise

SOURCE_NAMES = ("csv", "parquet", "yearly_csv", "jdbc")


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | None = None,
    limit: int | None = None,
    order: Sequence[str | Column] = ("row_order",),
    file_order: bool = False,
) -> DataFrame:
    """CSV with a header and its rows numbered uniquely as `row_order`, in file order within each task.

    Without a schema every column is text, so nothing is scanned to guess types. A limit keeps the
    first rows of `order`, the same ones on any partitioning. With `file_order` the numbers run from 0 through
    all files by name, which costs one more scan of the files that counts the rows of each block.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(path if isinstance(path, str) else list(path))
    df = number_in_file_order(df) if file_order else df.withColumn("row_order", F.monotonically_increasing_id())
    return df if limit is None else df.orderBy(*order).limit(limit)


def number_in_file_order(scan: DataFrame, column: str = "row_order") -> DataFrame:
    """Numbers the rows of a file scan from 0 by file path, place of the block in the file and line.

    Spark packs files into tasks by size, so task order isn't file order. Rows are numbered within their block as
    they are read; the blocks (a few columns each, as many as the scan has splits) are counted and put in order.
    """
    df = scan.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    blocks = df.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    in_file = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = materialise(blocks.withColumn("_before", F.coalesce(F.sum("_rows").over(in_file), F.lit(0))))
    files = blocks.groupBy("_file").agg(F.sum("_rows").alias("_file_rows"))
    # One row a file: the running total over all files is a short list.
    by_name = Window.partitionBy(F.lit(0)).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("_files_before", F.coalesce(F.sum("_file_rows").over(by_name), F.lit(0)))
    places = blocks.join(files, "_file").select(
        "_file", "_block", (F.col("_files_before") + F.col("_before") - F.col("_first")).alias("_shift")
    )
    out = lookup_join(df, places, ["_file", "_block"], "inner").withColumn(column, F.col("_id") + F.col("_shift"))
    return out.drop("_file", "_block", "_id", "_shift")


def read_yearly(
    spark: SparkSession, path_of_year: str, first_year: int, last_year: int, date_col: str = "sale_date"
) -> DataFrame:
    """Union of yearly CSV pulls at `path_of_year` (with `{year}`), each kept to its own year.

    `row_order` numbers the rows of all years, earlier years first, so it is unique."""
    parts = []
    for year in range(first_year, last_year + 1):
        part = read_csv(spark, path_of_year.format(year=year))
        parts.append(part.where(F.year(day_of(part, date_col)) == year))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return whole.withColumn("row_order", F.monotonically_increasing_id())


def coordinate_coverage(df: DataFrame) -> DataFrame:
    """One row: rows, rows with a latitude, and their percentage."""
    found = F.count("latitude")
    return df.agg(
        F.count("*").alias("rows"),
        found.alias("with_coordinates"),
        F.coalesce(F.try_divide(found, F.count("*")) * 100, F.lit(0.0)).alias("coverage_pct"),
    )


def coordinates_table(df: DataFrame) -> DataFrame:
    """Parcel coordinates from a side table: bbl, latitude, longitude; rows without latitude are dropped."""
    out = df.select(
        number_of(df, "bbl").cast("long").alias("bbl"),
        number_of(df, "latitude").alias("latitude"),
        number_of(df, "longitude").alias("longitude"),
    )
    return out.where(F.col("latitude").isNotNull())


def attach_coordinates(df: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Fill missing coordinates by parcel id; `coordinates` may list a parcel more than once.

    Of several coordinates the smallest counts: by latitude, then longitude (null first). Only rows that lack a
    coordinate meet the table, and only parcels of such rows are settled; all other rows stay where they are.
    """
    known = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    lacking = df.where(~known)
    wanted = lacking.where(F.col("bbl").isNotNull()).select("bbl").distinct()
    side = coordinates.join(broadcast_if_small(materialise(wanted)), "bbl", "left_semi")
    # Plain numbers are aggregated by hash, where a minimum of pairs would sort all rows.
    side = side.groupBy("bbl", "latitude").agg(F.min("longitude").alias("_longitude"), F.count_if(F.col("longitude").isNull()).alias("_none"))
    side = side.withColumn("_longitude", F.when(F.col("_none") == 0, F.col("_longitude"))).groupBy("bbl")
    side = side.agg(F.min("latitude").alias("_latitude"), F.min_by("_longitude", "latitude").alias("_longitude"))
    filled = lookup_join(lacking, side, ["bbl"]).withColumns(
        {"latitude": F.coalesce("latitude", "_latitude"), "longitude": F.coalesce("longitude", "_longitude")}
    )
    filled = filled.drop("_latitude", "_longitude")
    return df.where(known).select(filled.columns).union(filled)


def jdbc_options(
    url: str,
    query: str,
    limit: int | None = None,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    **extra: str,
) -> dict[str, str]:
    """Options of a JDBC scan of any query; a limit wraps the query, a partition column splits the read."""
    sql = query if limit is None else f"SELECT * FROM ({query}) q LIMIT {int(limit)}"
    options = {"url": url, "dbtable": f"({sql}) q", **extra}
    if partition_column and limit is None:
        if bounds is None:
            raise ValueError("a partition column needs bounds, or all rows land in one partition")
        low, high = bounds
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(low),
            "upperBound": str(high),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(spark: SparkSession, url: str, query: str = "SELECT * FROM sales", **kwargs) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, query, **kwargs)).load()


@dataclass(frozen=True)
class Extract:
    """A scanned table and its one-row lineage table."""

    df: DataFrame
    lineage: DataFrame


def content_fingerprint(df: DataFrame) -> list[Column]:
    """Aggregates that name a table's content whatever its order and partitioning: the sums, modulo 2^64, of two
    64-bit hashes of every row (a multiset hash: a repeated row counts each time), as 16 hexadecimal digits each.

    Columns are taken by name, nulls apart from every value.
    """
    # Nulls are skipped by the hash, so each value says whether it is there.
    cells = [c for name in sorted(df.columns) for c in (F.col(f"`{name}`").isNull(), F.col(f"`{name}`").cast("string"))]
    word = F.lit(2**32).cast("decimal(38,0)")
    sums = []
    for salt in ("a", "b"):
        mixed = F.xxhash64(F.lit(salt), *cells)
        # Halves are summed as decimals, which hold the sum of any number of rows; the low half carries over.
        low = F.coalesce(F.sum(mixed.bitwiseAND(F.lit(0xFFFFFFFF)).cast("decimal(38,0)")), F.lit(0))
        high = F.coalesce(F.sum(F.shiftrightunsigned(mixed, 32).cast("decimal(38,0)")), F.lit(0))
        carry = ((low - low % word) / word).cast("decimal(38,0)")
        sums.append(F.format_string("%08x%08x", ((high + carry) % word).cast("long"), (low % word).cast("long")))
    return sums


def lineage(df: DataFrame, source_id: str, detail: str) -> DataFrame:
    """One row: source id, detail, row count, fingerprints and extraction time.

    `source_fingerprint` names the extract (source, detail, row count), `content_fingerprint` the rows themselves:
    it stays the same under any order and partitioning and changes with a single cell.
    """
    text = F.concat_ws(":", F.lit(source_id), F.lit(detail), F.col("row_count").cast("string"))
    one, two = content_fingerprint(df)
    return df.agg(F.count("*").alias("row_count"), F.concat(one, two).alias("content_fingerprint")).select(
        F.lit(source_id).alias("source_id"),
        F.lit(detail).alias("detail"),
        "row_count",
        F.substring(F.sha2(text, 256), 1, 16).alias("source_fingerprint"),
        "content_fingerprint",
        F.current_timestamp().alias("extracted_at"),
    )


def get_source(spark: SparkSession, name: str, limit: int | None = None, **config) -> Extract:
    """Scan a source by name: csv or parquet (`path`), yearly_csv (`path`, years) or jdbc (`url`, `query`)."""
    kind = name.strip().lower()
    if kind not in SOURCE_NAMES:
        raise ValueError(f"unsupported data source {name!r}, expected one of {SOURCE_NAMES}")
    if kind == "jdbc":
        df = read_jdbc(spark, limit=limit, **config)
        return Extract(df, lineage(df, kind, config.get("query", "SELECT * FROM sales")))
    path = config.get("path")
    if path is None:
        raise ValueError(f"{kind} source needs a path")
    if kind == "csv":
        df = read_csv(spark, path, limit=limit)
    elif kind == "parquet":
        df = spark.read.parquet(path)
        df = df if limit is None else df.orderBy(*df.columns).limit(limit)
    else:
        df = read_yearly(spark, path, config.get("first_year", 2019), config.get("last_year", 2024))
        df = df if limit is None else df.orderBy(day_of(df, "sale_date"), "row_order").limit(limit)
    return Extract(df, lineage(df, kind, str(path)))


def training_scan(sales: DataFrame, limit: int | None = None, order: Sequence[str | Column] = ("sale_date",)) -> DataFrame:
    """Training columns of priced and dated sales; a table without the tier proxy gets it as null."""
    if "price_tier_proxy" not in sales.columns:
        sales = sales.withColumn("price_tier_proxy", F.lit(None).cast("string"))
    kept = sales.where(F.col("sale_price").isNotNull() & F.col("sale_date").isNotNull())
    if limit is not None:
        # All columns break ties, so the rows are the same on any partitioning.
        kept = kept.orderBy(*order, *kept.columns).limit(limit)
    return kept.select(*TRAINING_COLUMNS)


def latest_sales(sales: DataFrame, n: int = 10_000, tie_break: Sequence[str] = ("id",)) -> DataFrame:
    """Newest n sales with the display columns the table has."""
    cols = [c for c in LATEST_SALES_COLUMNS if c in sales.columns]
    return sales.orderBy(F.col("sale_date").desc(), *tie_break).limit(n).select(*cols)
