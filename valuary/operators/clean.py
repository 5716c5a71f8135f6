"""Cleaning raw sales and mapping foreign feeds onto the canonical columns."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuary.functions.parse import day_of, number_of
from valuary.functions.property import SEGMENT_BY_PREFIX, borough_name, category_prefix, segment
from valuary.schemas import CANONICAL_OPTIONAL, CANONICAL_REQUIRED, TRAINING_REQUIRED

# The market price floor and the source column renames.
MIN_MARKET_PRICE = 10_000
SALES_RENAMES = {
    "building_class_at_time_of": "building_class",
    "tax_class_at_time_of_sale": "tax_class",
    "bin": "bin_number",
    "census_tract_2020": "census_tract",
}
NUMERIC_TEXT_COLUMNS = ("land_square_feet", "gross_square_feet", "sale_price")


def standardise_names(df: DataFrame, renames: dict[str, str] = SALES_RENAMES) -> DataFrame:
    """Column names trimmed, lower case, blanks as underscores, then renamed."""
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    return df.toDF(*[renames.get(n, n) for n in names])


def coerce_numbers(df: DataFrame, columns: Sequence[str] = NUMERIC_TEXT_COLUMNS) -> DataFrame:
    return df.withColumns({c: number_of(df, c) for c in columns if c in df.columns})


def _is_type(df: DataFrame, name: str, kind: type) -> bool:
    return name in df.columns and isinstance(df.schema[name].dataType, kind)


def market_sales(df: DataFrame, floor: float = MIN_MARKET_PRICE) -> DataFrame:
    """Sales at or above the market floor. On a typed column the comparison reaches the file scan."""
    price = F.col("sale_price")
    enough = price >= floor
    if _is_type(df, "sale_price", T.FractionalType):
        enough = enough & ~F.isnan(price)
    return df.where(enough)


def residential_sales(df: DataFrame) -> DataFrame:
    return df.where(category_prefix(F.col("building_class_category")).isin(*SEGMENT_BY_PREFIX))


def located_sales(df: DataFrame) -> DataFrame:
    return df.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def valid_parcels(df: DataFrame) -> DataFrame:
    """Parcel id as a positive long; rows without one are dropped."""
    if not _is_type(df, "bbl", T.IntegralType):
        df = df.withColumn("bbl", number_of(df, "bbl").cast("long"))
    return df.withColumn("bbl", F.col("bbl").cast("long")).where(F.col("bbl") > 0)


def parse_sale_dates(df: DataFrame) -> DataFrame:
    """Typed sale date (bad text is an error) with year, month and quarter; unknown construction year as 0."""
    day = F.col("sale_date")
    return df.withColumns(
        {
            "sale_date": day_of(df, "sale_date", strict=True),
            "year_built": F.coalesce(number_of(df, "year_built").cast("long"), F.lit(0).cast("long")),
        }
    ).withColumns({"sale_year": F.year(day), "sale_month": F.month(day), "sale_quarter": F.quarter(day)})


def clean_sales(df: DataFrame) -> DataFrame:
    """Names, numbers and dates normalised; only located residential market sales of valid parcels kept."""
    df = standardise_names(df)
    if _is_type(df, "sale_price", T.NumericType):
        df = coerce_numbers(market_sales(df))
    else:
        df = market_sales(coerce_numbers(df))
    if "building_class_category" in df.columns:
        df = residential_sales(df)
    return parse_sale_dates(valid_parcels(located_sales(df)))


def normalise_latest_sales(df: DataFrame) -> DataFrame:
    """Display form of a sales scan: names, parsed date, borough name and a segment for every row."""
    df = standardise_names(df, {k: v for k, v in SALES_RENAMES.items() if k != "bin"})
    if "sale_date" in df.columns:
        df = df.withColumn("sale_date", day_of(df, "sale_date"))
    name = borough_name(F.col("borough")) if "borough" in df.columns else F.lit("Unknown")
    df = df.withColumn("borough_name", name)
    if "property_segment" not in df.columns:
        known = "building_class_category" in df.columns
        df = df.withColumn("property_segment", segment(F.col("building_class_category")) if known else F.lit("OTHER"))
    return df


def load_mapping(path: str | None) -> dict:
    """Column mapping with `rename` and `defaults`, from a JSON or YAML file."""
    if path is None:
        return {}
    with open(path, encoding="utf-8") as handle:
        text = handle.read()
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        import yaml

        return yaml.safe_load(text) or {}


def to_canonical(df: DataFrame, mapping: dict | None = None) -> DataFrame:
    """Rename and complete a feed to the canonical columns, coercing types; prices below the floor become null."""
    mapping = mapping or {}
    out = df.withColumnsRenamed(mapping.get("rename", {}))
    defaults = {c: F.lit(v) for c, v in mapping.get("defaults", {}).items() if c not in out.columns}
    out = out.withColumns(defaults) if defaults else out
    absent = {
        c: F.lit(None).cast("string") for c in (*CANONICAL_REQUIRED, *CANONICAL_OPTIONAL) if c not in out.columns
    }
    out = out.withColumns(absent) if absent else out
    price = number_of(out, "sale_price")
    return out.withColumns(
        {
            "sale_date": day_of(out, "sale_date"),
            "sale_price": F.when(price >= MIN_MARKET_PRICE, price),
            "latitude": number_of(out, "latitude"),
            "longitude": number_of(out, "longitude"),
            "gross_square_feet": number_of(out, "gross_square_feet"),
            "year_built": F.coalesce(number_of(out, "year_built").cast("long"), F.lit(0).cast("long")),
        }
    )


def mapping_report(raw: DataFrame, canonical: DataFrame, mapping: dict | None, path: str | None = None) -> DataFrame:
    """One row telling how a mapping was applied."""
    mapping = mapping or {}
    schema = "mapping_path string, rename_count int, defaults_count int, input_columns int, canonical_columns int"
    row = (
        path,
        len(mapping.get("rename", {})),
        len(mapping.get("defaults", {})),
        len(raw.columns),
        len(canonical.columns),
    )
    return raw.sparkSession.createDataFrame([row], schema)


def prepare_training_frame(df: DataFrame, min_rows: int = 50) -> DataFrame:
    """Typed market sales with date, price and cell; an error when columns or rows are missing."""
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    missing = [c for c in TRAINING_REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"training data lacks required columns: {missing}")
    frame = df.withColumns({"sale_date": day_of(df, "sale_date"), "sale_price": number_of(df, "sale_price")})
    frame = frame.where(
        F.col("sale_date").isNotNull() & F.col("h3_index").isNotNull() & (F.col("sale_price") >= MIN_MARKET_PRICE)
    )
    if min_rows and frame.limit(min_rows).count() < min_rows:
        raise ValueError(f"training needs at least {min_rows} rows after filtering")
    return frame


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Only the columns of `schema`, in its order and types; NaN becomes null and absent columns are null."""
    out = []
    for field in schema.fields:
        if field.name not in df.columns:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        c = F.col(field.name)
        if isinstance(df.schema[field.name].dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.cast(field.dataType).alias(field.name))
    return df.select(*out)
