"""Model features: location, age, seasonality, cell price lag and the time-ordered split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuary.functions import calendar
from valuary.functions.property import building_age, distance_to_center_km, grid_cell, price_per_sqft
from valuary.operators.ordered import at_or_before, boundary_rows, group_quantiles
from valuary.session import broadcast_if_small, materialise

# Columns a model may not see, and those known at inference time.
TARGET_DERIVED = (
    "sale_price",
    "price_tier",
    "predicted_price",
    "prediction_error",
    "abs_pct_error",
    "sale_price_true",
    "sale_price_pred",
    "target",
    "y",
)
INFERENCE_COLUMNS = (
    "gross_square_feet",
    "year_built",
    "building_age",
    "residential_units",
    "total_units",
    "distance_to_center_km",
    "h3_price_lag",
    "days_since_2019_start",
    "month_sin",
    "month_cos",
    "borough",
    "building_class",
    "property_segment",
    "neighborhood",
    "rate_regime_bucket",
    "price_tier_proxy",
)

TEMPORAL_FEATURES = {
    "days_since_2019_start": calendar.days_since_trend_start,
    "month_sin": calendar.month_sin,
    "month_cos": calendar.month_cos,
    "rate_regime_bucket": calendar.rate_regime,
}


def add_location_features(df: DataFrame, cell_size: float = 0.01, as_of_year: int = 2025) -> DataFrame:
    """Grid cell, distance to centre, building age and price per square foot."""
    lat, lon = F.col("latitude"), F.col("longitude")
    return df.withColumns(
        {
            "h3_index": grid_cell(lat, lon, cell_size),
            "distance_to_center_km": distance_to_center_km(lat, lon),
            "building_age": building_age(F.col("year_built"), as_of_year),
            "price_per_sqft": price_per_sqft(F.col("sale_price"), F.col("gross_square_feet")),
        }
    )


def add_temporal_features(df: DataFrame, keep_existing: bool = False) -> DataFrame:
    """Trend, season and rate regime from the sale date; `keep_existing` only fills absent columns."""
    day = F.col("sale_date").cast("date") if "sale_date" in df.columns else F.lit(None).cast("date")
    wanted = {n: f(day) for n, f in TEMPORAL_FEATURES.items() if not (keep_existing and n in df.columns)}
    return df.withColumns(wanted) if wanted else df


def engineer_features(df: DataFrame, cell_size: float = 0.01, as_of_year: int = 2025) -> DataFrame:
    return add_temporal_features(add_location_features(df, cell_size, as_of_year))


def fit_cell_price_lag(train: DataFrame) -> DataFrame:
    """Median price per cell, and over all rows as cell `__global__`."""
    scoped = train.select(
        F.explode(F.array_compact(F.array("h3_index", F.lit("__global__")))).alias("h3_index"), "sale_price"
    )
    return materialise(group_quantiles(scoped, ["h3_index"], "sale_price", {"h3_price_lag": 0.5}).drop("n"))


def apply_cell_price_lag(df: DataFrame, medians: DataFrame) -> DataFrame:
    """Cell median of the fitted rows, the overall median where the cell is unknown."""
    overall = medians.where("h3_index = '__global__'").select("h3_price_lag").first()
    cells = broadcast_if_small(medians.where("h3_index <> '__global__'"))
    out = df.drop("h3_price_lag").join(cells, ["h3_index"], "left")
    return out.withColumn("h3_price_lag", F.coalesce("h3_price_lag", F.lit(overall["h3_price_lag"] if overall else None)))


def add_cell_price_lag(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cell price lag fitted on train only and applied to both."""
    medians = fit_cell_price_lag(train)
    return apply_cell_price_lag(train, medians), apply_cell_price_lag(test, medians)


def with_cell_price_lag(df: DataFrame) -> DataFrame:
    """Cell price lag from the frame itself, unless it already carries one."""
    if "h3_price_lag" in df.columns and df.where("h3_price_lag is not null").limit(1).count():
        return df
    if not {"h3_index", "sale_price"} <= set(df.columns):
        return df.withColumn("h3_price_lag", F.lit(None).cast("double"))
    return apply_cell_price_lag(df, fit_cell_price_lag(df))


def time_split(df: DataFrame, test_size: float = 0.2, order: str = "row_order") -> tuple[DataFrame, DataFrame]:
    """First `1 - test_size` of the rows by sale date for training, the rest for testing.

    Only the border row is located; both parts are filters, nothing is sorted as a whole.
    """
    if not 0 < test_size < 0.5:
        raise ValueError("test_size must be between 0 and 0.5")
    keyed = df.select(F.lit("all").alias("scope"), F.unix_date("sale_date").alias("day"), F.col(order).alias("place"))

    def last_train(n: Column) -> list[Column]:
        return [F.floor(n.cast("double") * F.lit(1 - test_size)) - 1]

    border = boundary_rows(keyed, ["scope"], "day", "place", last_train, few_first=True).first()
    if border is None:
        raise ValueError("time split left the train or the test part empty")
    day, place = F.unix_date("sale_date"), F.col(order)
    early = at_or_before(day, place, F.lit(border["first"]), F.lit(border["second"]))
    return df.where(early), df.where(~early)


def check_feature_columns(columns: list[str], context: str = "feature columns") -> list[str]:
    """Names usable as features or routing keys; target-derived or unknown ones are an error."""
    names = [str(c).strip() for c in columns]
    leaking = sorted({c.lower() for c in names} & set(TARGET_DERIVED))
    if leaking:
        raise ValueError(f"{context}: target-derived columns are not allowed: {leaking}")
    unknown = sorted(set(names) - set(INFERENCE_COLUMNS))
    if unknown:
        raise ValueError(f"{context}: not available at inference time: {unknown}")
    return names


def check_training_contract(
    train: DataFrame, test: DataFrame, feature_columns: list[str], router_columns: list[str] = ()
) -> None:
    """Features and router columns are allowed, present in both parts, and not all null in train."""
    check_feature_columns(list(feature_columns), "training feature columns")
    if router_columns:
        check_feature_columns(list(router_columns), "training router columns")
    required = sorted({*feature_columns, *router_columns})
    gaps = {part: [c for c in required if c not in df.columns] for part, df in (("train", train), ("test", test))}
    if any(gaps.values()):
        raise ValueError(f"training feature contract: missing required columns {gaps}")
    filled = train.agg(*[F.count(c).alias(c) for c in feature_columns]).first()
    empty = [c for c in feature_columns if filled[c] == 0]
    if empty:
        raise ValueError(f"training feature contract: all-null feature columns in train: {empty}")


def feature_contract_report(columns: list[str], spark) -> DataFrame:
    """One row per proposed column with its verdict: ok, target_derived or undocumented."""
    listed = spark.createDataFrame([(c,) for c in columns], "column_name string")
    name = F.trim("column_name")
    return listed.select(
        "column_name",
        F.when(F.lower(name).isin(*TARGET_DERIVED), "target_derived")
        .when(~name.isin(*INFERENCE_COLUMNS), "undocumented")
        .otherwise("ok")
        .alias("verdict"),
    )
