"""Property identity, duplicate removal and resale history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valuary.functions.parse import strip
from valuary.functions.property import unit_from_address, unit_token
from valuary.operators.skew import HOT_MIN_ROWS, HOT_SHARE, hot_keys
from valuary.session import materialise

SALE_KEY = ("property_id", "sale_date", "sale_price")
HISTORY_COLUMNS = (
    "sale_sequence",
    "is_latest_sale",
    "previous_sale_price",
    "previous_sale_date",
    "price_change_pct",
    "days_since_last_sale",
)


def add_property_id(df: DataFrame) -> DataFrame:
    """Property id (parcel, with the unit where one is known) and where the unit came from."""
    none = F.lit(None).cast("string")
    listed = unit_token(F.col("apartment_number"), strict=False) if "apartment_number" in df.columns else none
    parsed = unit_from_address(F.col("address")) if "address" in df.columns else none
    # An address is taken apart only where no unit is listed.
    df = df.withColumn("_listed", listed).withColumn("_parsed", F.when(F.col("_listed").isNull(), parsed))
    source = F.when(F.col("_listed").isNotNull(), "apartment_number").when(
        F.col("_parsed").isNotNull(), "address_suffix"
    )
    df = df.withColumns(
        {
            "unit_identifier": F.coalesce("_listed", "_parsed"),
            "property_id_source": source.otherwise("bbl_only"),
        }
    ).drop("_listed", "_parsed")
    return df.withColumn("property_id", F.concat_ws("_", F.col("bbl").cast("long").cast("string"), "unit_identifier"))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row per key in the given order.

    Spark limits each map task to one row per key before the shuffle (window group limit), so a key
    with very many copies arrives as at most one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def deduplicate_sales(df: DataFrame, order: str = "row_order") -> DataFrame:
    """One row per property, date and price: the first in input order. Resales are kept."""
    return keep_first(df, SALE_KEY, [order])


def resale_history(identified: DataFrame, order: str = "row_order") -> DataFrame:
    """Sales without duplicates and with their history, from rows with a property id that begins with the parcel `bbl`.

    A property has no more rows than its parcel, so without an outsized parcel, which is counted on plain numbers,
    there is no outsized property: all rows then travel once, to their property, where duplicates and history are
    settled in one order. Otherwise duplicates go inside the map tasks first, and outsized properties are windowed
    in steps.
    """
    keys = ["property_id"]
    if materialise(hot_keys(identified, ["bbl"])).isEmpty():
        none = identified.sparkSession.createDataFrame([], identified.select(*keys).schema)
        return add_sales_history(deduplicate_sales(identified.repartition(*keys), order), order=order, hot=none)
    # Counted before the duplicates go, which costs one narrow scan instead of a second duplicate removal.
    return add_sales_history(deduplicate_sales(identified, order), order=order, hot=hot_keys(identified, keys))


def duplicate_metrics(df: DataFrame) -> DataFrame:
    """One row: key groups that repeat, and those among them with more than one address."""
    address = F.upper(strip(F.coalesce(F.col("address"), F.lit(""))))
    per_address = df.groupBy(*SALE_KEY, address.alias("address_norm")).agg(F.count("*").alias("n"))
    per_key = per_address.groupBy(*SALE_KEY).agg(F.sum("n").alias("n"), F.count("*").alias("addresses"))
    return per_key.agg(
        F.count_if(F.col("n") > 1).alias("duplicate_groups"),
        F.count_if((F.col("n") > 1) & (F.col("addresses") > 1)).alias("suspect_groups"),
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str] = SALE_KEY) -> DataFrame:
    """Distinct keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)


def _time_slot() -> Column:
    """Sub-group number of a sale inside a hot property; never decreases along (date, price)."""
    price_step = F.least(F.lit(1023), F.floor(F.log2(F.greatest(F.col("sale_price"), F.lit(0.0)) + 1) * 16))
    return F.unix_date("sale_date").cast("long") * 1024 + price_step


def add_sales_history(
    df: DataFrame,
    order: str | None = None,
    hot: DataFrame | None = None,
    hot_share: float = HOT_SHARE,
    hot_min_rows: int = HOT_MIN_ROWS,
) -> DataFrame:
    """Sale sequence, latest flag, previous price and date, price change and holding time per property.

    Properties with an outsized share of all rows (`hot`, found here unless given) are windowed per
    (date, price step) instead of all in one task; the counts and last rows of the earlier steps are
    carried over. All other properties are one step each, so one window and one shuffle serve both.
    """
    if hot is None:
        hot = hot_keys(df, ["property_id"], hot_share, hot_min_rows)
    hot = materialise(hot)
    if hot.count() == 0:
        none = {"_slot": "bigint", "_seq_before": "bigint", "_price_before": "double", "_date_before": "date", "_latest": "date"}
        marked = df.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
        group = Window.partitionBy("property_id")
    else:
        marked = _with_carried_steps(df, hot)
        group = Window.partitionBy("property_id", "_slot")
    ordered = group.orderBy("sale_date", "sale_price", *([order] if order else []))
    out = marked.withColumns(
        {
            "_rn": F.row_number().over(ordered),
            "_lag_price": F.lag("sale_price").over(ordered),
            "_lag_date": F.lag("sale_date").over(ordered),
            "_group_latest": F.max("sale_date").over(group),
        }
    )
    first = F.col("_rn") == 1
    out = out.withColumns(
        {
            "sale_sequence": (F.col("_rn") + F.coalesce("_seq_before", F.lit(0))).cast("int"),
            "is_latest_sale": F.col("sale_date") == F.coalesce("_latest", "_group_latest"),
            "previous_sale_price": F.when(first, F.col("_price_before")).otherwise(F.col("_lag_price")),
            "previous_sale_date": F.when(first, F.col("_date_before")).otherwise(F.col("_lag_date")),
        }
    )
    change = (F.col("sale_price") - F.col("previous_sale_price")) / F.col("previous_sale_price") * 100
    out = out.withColumns(
        {
            "price_change_pct": change,
            "days_since_last_sale": F.datediff("sale_date", "previous_sale_date"),
        }
    )
    return out.select(*df.columns, *HISTORY_COLUMNS)


def _with_carried_steps(df: DataFrame, hot: DataFrame) -> DataFrame:
    """Adds `_slot` (the step of a hot property, -1 elsewhere) and what its earlier steps carry into it."""
    hot = F.broadcast(hot)
    marked = df.join(hot.withColumn("_hot", F.lit(True)), "property_id", "left")
    marked = marked.withColumn("_slot", F.when(F.col("_hot"), _time_slot()).otherwise(F.lit(-1).cast("long"))).drop("_hot")
    steps = df.select("property_id", "sale_date", "sale_price").join(hot, "property_id", "left_semi")
    steps = steps.groupBy("property_id", _time_slot().alias("_slot")).agg(
        F.count("*").alias("_n"), F.max("sale_date").alias("_date"), F.max("sale_price").alias("_price")
    )
    along = Window.partitionBy("property_id").orderBy("_slot")
    steps = steps.select(
        "property_id",
        "_slot",
        F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_seq_before"),
        F.lag("_price").over(along).alias("_price_before"),
        F.lag("_date").over(along).alias("_date_before"),
        F.max("_date").over(Window.partitionBy("property_id")).alias("_latest"),
    )
    return marked.join(steps, ["property_id", "_slot"], "left")
