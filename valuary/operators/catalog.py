"""Property catalogue: normalised records, search, map clusters and price history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuary.functions.parse import int_in_range, number_of, strip
from valuary.functions.property import borough_key, upper_key, zip5
from valuary.operators.identity import keep_first

PREVIEW_COLUMNS = (
    "property_id",
    "address",
    "borough",
    "zip_code",
    "property_segment",
    "price_tier_proxy",
    "lat",
    "lng",
    "data_quality_status",
)
SEARCHED = ("address", "borough", "property_segment")
REQUIRED_FEATURES = ("gross_square_feet", "year_built", "total_units", "building_class")


def _text(df: DataFrame, name: str) -> Column:
    return F.nullif(strip(F.col(name).cast("string")), F.lit("")) if name in df.columns else F.lit(None).cast("string")


def _raw(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _catalogue_id(df: DataFrame) -> Column:
    """Property id, else one made of parcel, address and date."""
    fallback = F.concat_ws(
        ":", F.coalesce(_text(df, "bbl"), F.lit("unknown_bbl")), F.upper(_text(df, "address")), F.coalesce(_text(df, "sale_date"), F.lit("na"))
    )
    return F.coalesce(_text(df, "property_id"), fallback)


def _usable(lat: Column, lng: Column, address: Column) -> Column:
    return lat.between(-90, 90) & lng.between(-180, 180) & address.isNotNull()


def catalogue_records(df: DataFrame) -> DataFrame:
    """Normalised catalogue rows; rows without usable coordinates or address are dropped."""
    lat, lng, address = number_of(df, "latitude"), number_of(df, "longitude"), _text(df, "address")
    sqft = number_of(df, "gross_square_feet")
    # Names that differ from the raw columns keep every expression bound to the raw values.
    new = {
        "_property_id": _catalogue_id(df),
        "_address": address,
        "_borough": borough_key(_raw(df, "borough")),
        "_zip_code": zip5(_raw(df, "zip_code")),
        "_property_segment": upper_key(_raw(df, "property_segment"), "UNKNOWN"),
        "_price_tier_proxy": upper_key(_text(df, "price_tier_proxy")),
        "_lat": lat,
        "_lng": lng,
        "_gross_square_feet": F.when(sqft > 0, sqft),
        "_year_built": int_in_range(number_of(df, "year_built"), 1800, 2100),
        "_residential_units": int_in_range(number_of(df, "residential_units"), 0),
        "_total_units": int_in_range(number_of(df, "total_units"), 1),
        "_building_class": _text(df, "building_class"),
        "_sale_date": _text(df, "sale_date"),
    }
    order = [c for c in ("row_order",) if c in df.columns]
    out = df.select(*[c.alias(n) for n, c in new.items()], *[F.col(c).alias(f"_{c}") for c in order])
    out = out.toDF(*[c.removeprefix("_") for c in out.columns])
    out = out.where(_usable(F.col("lat"), F.col("lng"), F.col("address")))
    checks = [F.col(c).isNotNull().cast("int") for c in (*REQUIRED_FEATURES, "sale_date")]
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in REQUIRED_FEATURES]))
    out = out.withColumns(
        {"feature_completeness": F.round(sum(checks) / F.lit(len(checks)), 2), "missing_required_features": missing}
    )
    score = F.col("feature_completeness")
    quality = F.when(score >= 0.9, "ready").when(score >= 0.6, "partial").otherwise("sparse")
    return out.withColumns(
        {"data_quality_status": quality, "inference_ready": F.size("missing_required_features") == 0}
    )


def build_catalogue(df: DataFrame, order: str = "row_order") -> DataFrame:
    """Catalogue with one record per property id: the first in input order.

    The first row of an id is found by id and place alone; only rows that stay are normalised.
    """
    rows = df.where(_usable(number_of(df, "latitude"), number_of(df, "longitude"), _text(df, "address")))
    return catalogue_records(keep_first(rows.withColumn("_id", _catalogue_id(df)), ["_id"], [order]).drop("_id"))


def _matching(
    catalogue: DataFrame, borough: str | None, segment: str | None, zip_code: str | None, tier: str | None
) -> DataFrame:
    wanted = {
        "borough": borough and borough.upper(),
        "property_segment": segment and segment.upper(),
        "zip_code": zip_code,
        "price_tier_proxy": tier and tier.upper(),
    }
    for name, value in wanted.items():
        if value:
            catalogue = catalogue.where(F.col(name) == value)
    return catalogue


def search_properties(
    catalogue: DataFrame,
    query: str = "",
    borough: str | None = None,
    segment: str | None = None,
    zip_code: str | None = None,
    tier: str | None = None,
) -> DataFrame:
    """Records passing the equality filters whose address, borough or segment contains the query."""
    out = _matching(catalogue, borough, segment, zip_code, tier)
    text = query.strip().lower()
    if text:
        needle = F.lit(text)
        hit = F.lit(False)
        for name in SEARCHED:
            hit = hit | F.contains(F.lower(name), needle)
        out = out.where(hit)
    return out


def nearby_properties(
    catalogue: DataFrame, min_lng: float, min_lat: float, max_lng: float, max_lat: float, **filters
) -> DataFrame:
    """Records inside a bounding box that pass the equality filters."""
    names = ("borough", "segment", "zip_code", "tier")
    out = _matching(catalogue, *[filters.get(n) for n in names])
    return out.where(F.col("lng").between(min_lng, max_lng) & F.col("lat").between(min_lat, max_lat))


def first_page(found: DataFrame, limit: int) -> DataFrame:
    """Preview of the first records by property id."""
    return found.select(*PREVIEW_COLUMNS).orderBy("property_id").limit(limit)


def search_totals(catalogue: DataFrame, found: DataFrame) -> DataFrame:
    """One row: matching and catalogue record counts."""
    total = catalogue.agg(F.count("*")).scalar()
    return found.agg(F.count("*").alias("total_available")).withColumn("total_catalog", total)


def property_detail(catalogue: DataFrame, property_id: str) -> DataFrame:
    return catalogue.where(F.col("property_id") == property_id)


def explorer_sales(
    sales: DataFrame, boroughs: Sequence[str] = (), segments: Sequence[str] = (), latest_only: bool = True
) -> DataFrame:
    """Located sales of the chosen boroughs and segments, only the latest per property by default."""
    if latest_only and "is_latest_sale" in sales.columns:
        sales = sales.where("is_latest_sale")
    if boroughs:
        sales = sales.where(F.col("borough_name").isin(*boroughs))
    if segments:
        sales = sales.where(F.col("property_segment").isin(*segments))
    return sales.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def display_label(df: DataFrame) -> Column:
    """Name of a sale for lists: property id, else address and unit, else parcel; with its date."""
    if "property_id" in df.columns:
        name = F.col("property_id").cast("string")
    elif {"address", "apartment_number"} <= set(df.columns):
        name = F.concat(
            F.coalesce("address", F.lit("Unknown")), F.lit(" "), F.coalesce("apartment_number", F.lit(""))
        )
    else:
        name = F.concat(F.lit("BBL "), F.col("bbl").cast("string"))
    if "sale_date" not in df.columns:
        return name
    return F.concat(name, F.lit(" | "), F.coalesce(F.date_format("sale_date", "yyyy-MM-dd"), F.lit("unknown_date")))


def map_clusters(catalogue: DataFrame, zoom: float) -> DataFrame:
    """Points for a map: grid cells with their count and mean position; single points keep their own.

    From zoom 11.5 on every point stands alone. Columns: type, key, count, lat, lng.
    """
    if zoom >= 11.5:
        one = F.lit(1).cast("long")
        return catalogue.select(F.lit("property").alias("type"), F.col("property_id").alias("key"), one.alias("count"), "lat", "lng")
    size = F.lit(0.06 if zoom < 9 else 0.03)
    cell = F.concat_ws(":", F.floor(F.col("lng") / size).cast("string"), F.floor(F.col("lat") / size).cast("string"))
    cells = catalogue.groupBy(cell.alias("cell")).agg(
        F.count("*").alias("count"), F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.min("property_id").alias("id")
    )
    single = F.col("count") == 1
    return cells.select(
        F.when(single, "property").otherwise("cluster").alias("type"),
        F.when(single, F.col("id")).otherwise(F.col("cell")).alias("key"),
        "count",
        "lat",
        "lng",
    )


def filter_options(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct non-empty values of the filter columns, as sorted rows (option, value)."""
    entries = [F.struct(F.lit(c).alias("option"), F.col(c).cast("string").alias("value")) for c in columns]
    rows = df.select(F.explode(F.array(*entries)).alias("o")).select("o.option", "o.value")
    return rows.where(F.coalesce(F.col("value"), F.lit("")) != "").distinct().orderBy("option", "value")


def price_history(sales: DataFrame, wanted: DataFrame) -> DataFrame:
    """All sales of the wanted properties (by property_id, else bbl), newest first."""
    key = "property_id" if "property_id" in wanted.columns and "property_id" in sales.columns else "bbl"
    ids = wanted.where(F.col(key).isNotNull()).select(key).distinct()
    cols = ("sale_date", "sale_price", "price_change_pct", "sale_sequence", "is_latest_sale", "address")
    kept = [c for c in cols if c in sales.columns]
    return sales.join(ids, key, "left_semi").select(key, *kept).orderBy(key, F.col("sale_date").desc(), F.col("sale_price").desc())
