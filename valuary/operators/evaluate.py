"""Accuracy of predictions: overall, per segment and tier, per period, and their stability."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuary.functions.calendar import period_label
from valuary.functions.errors import HIT_BAND, abs_pct_error, r_squared
from valuary.functions.parse import nan_to_null
from valuary.operators.ordered import group_quantiles

SEGMENT_SPREAD_LIMIT = 0.15


def add_errors(df: DataFrame, actual: str = "sale_price", predicted: str = "predicted_price") -> DataFrame:
    """Signed error and absolute percentage error of each prediction."""
    error = F.col(predicted) - F.col(actual)
    return df.withColumns({"prediction_error": error, "abs_pct_error": F.abs(F.try_divide(error, F.col(actual)))})


def _typed(df: DataFrame, actual: str, predicted: str, *keep: Column) -> DataFrame:
    y, p = (nan_to_null(F.col(c).cast("double")) for c in (actual, predicted))
    return df.select(*keep, y.alias("y"), p.alias("p"))


def group_metrics(rows: DataFrame, keys: Sequence[str], approx: bool = False) -> DataFrame:
    """n, PPE10, MdAPE and R² per group of a frame with columns y and p.

    Rows with y <= 0 count for n and R² only. A null prediction counts as a miss and leaves MdAPE and
    R² of its group undefined.
    """
    keys = list(keys)
    rows = rows.select(*keys, "y", "p", abs_pct_error(F.col("y"), F.col("p")).alias("ape"))
    hits = F.sum((F.coalesce(F.col("ape") <= HIT_BAND, F.lit(False))).cast("double"))
    unknown = F.count_if((F.col("y") > 0) & F.col("p").isNull())
    gaps = F.count_if(F.col("y").isNull() | F.col("p").isNull())
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.coalesce(F.try_divide(hits, F.count_if(F.col("y") > 0)), F.lit(0.0)).alias("ppe10"),
        F.when((gaps == 0) & (F.count("*") > 1), r_squared(F.col("y"), F.col("p"))).alias("r2"),
        unknown.alias("_unknown"),
    )
    medians = group_quantiles(rows, keys, "ape", {"_mdape": 0.5}, approx=approx).drop("n")
    medians = medians.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    joined = sums.join(medians, same, "left")
    return joined.select(
        *keys, "n", "ppe10", F.when(F.col("_unknown") == 0, F.col("_mdape")).alias("mdape"), "r2"
    )


def _by_scope(df: DataFrame, scopes: dict[str, str | None], actual: str, predicted: str) -> DataFrame:
    """Rows repeated once per scope, as (group_type, group_name, y, p); null groups are left out."""
    entries = []
    for kind, name in scopes.items():
        group = F.lit("all") if name is None else F.col(name).cast("string")
        entry = F.struct(F.lit(kind).alias("group_type"), group.alias("group_name"))
        entries.append(F.when(group.isNotNull(), entry))
    rows = _typed(df, actual, predicted, F.explode(F.array_compact(F.array(*entries))).alias("g"))
    return rows.select("g.group_type", "g.group_name", "y", "p")


def valid_predictions(df: DataFrame, actual: str = "sale_price", predicted: str = "predicted_price") -> DataFrame:
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    return df.where(nan_to_null(y).isNotNull() & nan_to_null(p).isNotNull() & (y > 0))


def evaluate_predictions(
    df: DataFrame,
    actual: str = "sale_price",
    predicted: str = "predicted_price",
    segment_col: str = "property_segment",
    tier_col: str = "price_tier",
    approx: bool = False,
) -> DataFrame:
    """Metrics overall (group_type `overall`), per segment and per tier over the valid rows; groups of one row are skipped."""
    scopes: dict[str, str | None] = {"overall": None}
    scopes |= {k: c for k, c in (("segment", segment_col), ("price_tier", tier_col)) if c in df.columns}
    rows = _by_scope(valid_predictions(df, actual, predicted), scopes, actual, predicted)
    table = group_metrics(rows, ["group_type", "group_name"], approx)
    return table.where((F.col("group_type") == "overall") | (F.col("n") >= 2))


def segment_scorecard(
    df: DataFrame,
    actual: str = "sale_price",
    predicted: str = "predicted_price",
    segment_col: str = "property_segment",
    tier_col: str = "price_tier",
) -> DataFrame:
    """Segment and tier metrics over all rows, the invalid ones included."""
    scopes = {k: c for k, c in (("segment", segment_col), ("price_tier", tier_col)) if c in df.columns}
    return group_metrics(_by_scope(df, scopes, actual, predicted), ["group_type", "group_name"]).where("n >= 2")


def temporal_scorecard(
    df: DataFrame,
    freq: str = "Q",
    date_col: str = "sale_date",
    actual: str = "sale_price",
    predicted: str = "predicted_price",
) -> DataFrame:
    """Metrics per calendar period over the valid dated rows."""
    valid = valid_predictions(df.where(F.col(date_col).isNotNull()), actual, predicted)
    rows = _typed(valid, actual, predicted, period_label(F.col(date_col), freq).alias("period"))
    return group_metrics(rows, ["period"])


def temporal_stability(scorecard: DataFrame) -> DataFrame:
    """One row: spread, range and first-to-last change of the period metrics."""

    def change(metric: str) -> Column:
        return F.max_by(metric, "period") - F.min_by(metric, "period")

    return scorecard.agg(
        F.count("*").alias("temporal_period_count"),
        F.stddev_pop("mdape").alias("temporal_mdape_std"),
        F.stddev_pop("ppe10").alias("temporal_ppe10_std"),
        F.min("ppe10").alias("temporal_ppe10_min"),
        F.max("ppe10").alias("temporal_ppe10_max"),
        F.min("mdape").alias("temporal_mdape_min"),
        F.max("mdape").alias("temporal_mdape_max"),
        change("mdape").alias("temporal_mdape_last_minus_first"),
        change("ppe10").alias("temporal_ppe10_last_minus_first"),
    )


def segment_spread(metrics: DataFrame, limit: float = SEGMENT_SPREAD_LIMIT) -> DataFrame:
    """Widest PPE10 gap between segments and whether it exceeds the limit."""
    per_segment = metrics.where("group_type = 'segment'")
    gap = F.when(F.count("*") >= 2, F.max("ppe10") - F.min("ppe10")).otherwise(F.lit(0.0))
    return per_segment.agg(gap.alias("segment_ppe10_variance")).withColumn(
        "segment_variance_flag", F.col("segment_ppe10_variance") > limit
    )


def metrics_json(metrics: DataFrame) -> DataFrame:
    """One JSON document per metrics row, for export."""
    return metrics.select(
        "group_type", "group_name", F.to_json(F.struct("n", "ppe10", "mdape", "r2")).alias("metrics")
    )


def compare_models(left: DataFrame, right: DataFrame) -> DataFrame:
    """Metric differences (right minus left) per group found in both metric tables."""
    keys = ["group_type", "group_name"]
    a = left.select(*keys, *[F.col(c).alias(f"left_{c}") for c in ("n", "ppe10", "mdape", "r2")])
    b = right.select(*keys, *[F.col(c).alias(f"right_{c}") for c in ("n", "ppe10", "mdape", "r2")])
    joined = a.join(b, keys)
    return joined.withColumns(
        {f"delta_{c}": F.col(f"right_{c}") - F.col(f"left_{c}") for c in ("ppe10", "mdape", "r2")}
    )
