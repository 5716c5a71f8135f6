"""Fixed schemas and column lists of the tables this library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}


def _struct(columns: str) -> T.StructType:
    """Schema from `name type, ...`, without needing a running session."""
    pairs = (c.split() for c in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


SALES_SCHEMA = _struct(
    """
    bbl bigint, borough int, block int, lot int, address string, apartment_number string,
    neighborhood string, zip_code int, latitude double, longitude double,
    building_class_category string, building_class string, residential_units double,
    commercial_units double, total_units double, land_square_feet double, gross_square_feet double,
    year_built int, tax_class string, sale_price bigint, sale_date date, sale_year int,
    h3_index string, distance_to_center_km double, community_board int, council_district int,
    census_tract double, nta string, bin_number bigint, property_id string, sale_sequence int,
    is_latest_sale boolean, previous_sale_price bigint, previous_sale_date date,
    price_change_pct double, days_since_last_sale int, property_segment string, price_tier string,
    price_tier_proxy string, building_age int, price_per_sqft double, sale_month int,
    sale_quarter int, days_since_2019_start double, month_sin double, month_cos double,
    rate_regime_bucket string, sqft_imputed boolean, sqft_imputation_level string,
    year_built_imputed boolean
    """
)

PREDICTIONS_SCHEMA = _struct(
    """
    bbl bigint, predicted_price double, prediction_lower double, prediction_upper double,
    actual_price double, absolute_error double, percent_error double, model_version string,
    model_name string, prediction_date timestamp
    """
)

MODEL_PERFORMANCE_SCHEMA = _struct(
    """
    model_version string, model_name string, training_records int, test_records int,
    features_used string, r2_score double, mae double, mdape double, ppe10 double, ppe20 double,
    trained_at timestamp, notes string
    """
)

AUDIT_LOG_SCHEMA = _struct(
    """
    timestamp timestamp, property_id bigint, prompt_hash string, model string, input_tokens int,
    output_tokens int, cost_estimate double, success boolean, error_message string, latency_ms int
    """
)

DRIFT_SCHEMA = _struct(
    "feature string, reference_n bigint, current_n bigint, psi double, ks double, status string"
)

# The canonical column set.
CANONICAL_REQUIRED = (
    "sale_date",
    "sale_price",
    "latitude",
    "longitude",
    "property_segment",
    "gross_square_feet",
    "year_built",
)
CANONICAL_OPTIONAL = (
    "bbl",
    "borough",
    "block",
    "lot",
    "building_class",
    "building_class_category",
    "h3_index",
    "distance_to_center_km",
    "price_tier",
    "neighborhood",
    "residential_units",
    "total_units",
)

# Model features and the columns a training scan projects.
NUMERIC_FEATURES = (
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
)
CATEGORICAL_FEATURES = (
    "borough",
    "building_class",
    "property_segment",
    "neighborhood",
    "rate_regime_bucket",
)
TRAINING_COLUMNS = (
    "sale_date",
    "sale_price",
    "h3_index",
    "gross_square_feet",
    "year_built",
    "building_age",
    "residential_units",
    "total_units",
    "distance_to_center_km",
    "borough",
    "building_class",
    "property_segment",
    "price_tier",
    "price_tier_proxy",
    "neighborhood",
)
TRAINING_REQUIRED = tuple(c for c in TRAINING_COLUMNS if c not in ("price_tier", "price_tier_proxy"))

# Columns of the newest-sales view.
LATEST_SALES_COLUMNS = (
    "id",
    "bbl",
    "borough",
    "block",
    "lot",
    "address",
    "apartment_number",
    "neighborhood",
    "latitude",
    "longitude",
    "building_class_category",
    "building_class",
    "residential_units",
    "total_units",
    "gross_square_feet",
    "year_built",
    "sale_price",
    "sale_date",
    "h3_index",
    "distance_to_center_km",
    "property_id",
    "property_segment",
    "price_tier",
    "price_tier_proxy",
    "building_age",
    "days_since_2019_start",
    "month_sin",
    "month_cos",
    "rate_regime_bucket",
    "is_latest_sale",
)
