"""Value ranges around model predictions and the rule-based batch valuation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuary.functions.errors import valuation_status
from valuary.functions.parse import js_round, lookup, round2
from valuary.functions.property import upper_key
from valuary.session import broadcast_if_small, materialise

# Dollars per square foot by borough, and for any other place.
BOROUGH_PPSF = {"MANHATTAN": 1200.0, "BROOKLYN": 780.0, "QUEENS": 610.0, "BRONX": 420.0, "STATEN_ISLAND": 500.0}
DEFAULT_PPSF = 620.0
DEFAULT_PPE10 = 0.28
INPUT_COMPLETENESS = 0.9

DRIVER_TYPE = "array<struct<feature:string,impact:bigint,display:string>>"


def _bounded(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def add_valuation_status(df: DataFrame) -> DataFrame:
    return df.withColumn("valuation_status", valuation_status(F.col("sale_price"), F.col("predicted_price")))


def add_segment_metrics(df: DataFrame, metrics: DataFrame) -> DataFrame:
    """Adds the MdAPE of each row's own segment, the overall one (0.10 if there is none) as fallback."""
    metrics = materialise(metrics)
    overall = metrics.where("group_type = 'overall'").select("mdape").first()
    fallback = overall["mdape"] if overall and overall["mdape"] is not None else 0.10
    own = metrics.where("group_type = 'segment'").select(
        F.col("group_name").alias("property_segment"), F.col("mdape").alias("_own")
    )
    out = df.join(broadcast_if_small(own), ["property_segment"], "left")
    return out.withColumns(
        {
            "mdape_used": F.coalesce("_own", F.lit(fallback)),
            "mdape_source": F.when(F.col("_own").isNotNull(), "segment").otherwise("overall"),
        }
    ).drop("_own")


def add_value_range(df: DataFrame) -> DataFrame:
    """Low and high value and a confidence score from `mdape_used`."""
    price, spread = F.col("predicted_price"), F.col("mdape_used")
    return df.withColumns(
        {
            "low_value_bound": price * (1 - spread),
            "high_value_bound": price * (1 + spread),
            "confidence_score": _bounded(1 - spread, 0.0, 1.0),
        }
    )


def _borough_ppsf() -> Column:
    return F.coalesce(lookup(BOROUGH_PPSF, upper_key(F.col("borough"))), F.lit(DEFAULT_PPSF))


def rule_based_valuation(df: DataFrame, as_of_year: int) -> DataFrame:
    """Price from floor area, borough rate, age and unit count, with a band of 9 percent either way.

    Columns read: borough (name), gross_square_feet, year_built, total_units.
    """
    age = _bounded(F.lit(as_of_year) - F.col("year_built"), 0.0, 150.0)
    by_age = _bounded(1 - age * 0.0012, 0.72, 1.08)
    by_units = F.when(F.col("total_units") > 4, 0.94).otherwise(1.0)
    price = js_round(F.col("gross_square_feet") * _borough_ppsf() * by_age * by_units)
    out = df.withColumn("predicted_price", price)
    return out.withColumns(
        {
            "interval_low": js_round(F.col("predicted_price") * 0.91),
            "interval_high": js_round(F.col("predicted_price") * 1.09),
        }
    )


def add_value_drivers(df: DataFrame, as_of_year: int) -> DataFrame:
    """Signed contributions to the rule-based price as arrays of raising and lowering drivers."""

    def driver(feature: str, impact: Column, display: str) -> Column:
        return F.struct(F.lit(feature).alias("feature"), impact.alias("impact"), F.lit(display).alias("display"))

    factor = _borough_ppsf() / F.lit(DEFAULT_PPSF)
    units = F.col("total_units")
    up = F.array(
        driver("gross_square_feet", js_round(F.col("gross_square_feet") * 42.0), "Larger interior size"),
        driver("borough", js_round(75000.0 * (factor - 1)), "Location demand baseline"),
    )
    years = F.lit(as_of_year) - F.col("year_built")
    penalty = F.when(units > 8, -js_round((units - 8) * 3500.0)).otherwise(F.lit(0).cast("long"))
    down = F.array(
        driver("building_age", -js_round(years * 420.0), "Older building profile"),
        driver("total_units", penalty, "Higher unit complexity"),
    )
    return df.withColumns(
        {
            "drivers_positive": F.filter(up, lambda d: d["impact"] > 0).cast(DRIVER_TYPE),
            "drivers_negative": F.filter(down, lambda d: d["impact"] < 0).cast(DRIVER_TYPE),
        }
    )


def top_drivers(df: DataFrame, k: int = 8) -> DataFrame:
    """The k drivers of each row with the largest absolute impact, in that order."""

    def stronger(a: Column, b: Column) -> Column:
        gap = F.abs(b["impact"]) - F.abs(a["impact"])
        return F.signum(gap).cast("int")

    both = F.concat("drivers_positive", "drivers_negative")
    return df.withColumn("top_drivers", F.slice(F.array_sort(both, stronger), 1, k))


def add_confidence(df: DataFrame, ppe10: str = "segment_ppe10") -> DataFrame:
    """Calibration, support, score and band from the segment PPE10 of each row."""
    share = F.coalesce(F.col(ppe10), F.lit(DEFAULT_PPE10))
    calibration, support = _bounded(share / 0.6, 0.25, 0.95), _bounded(share / 0.5, 0.25, 0.95)
    score = round2(calibration * 0.45 + support * 0.35 + F.lit(INPUT_COMPLETENESS * 0.2))
    out = df.withColumns(
        {
            "segment_calibration": round2(calibration),
            "support_coverage": round2(support),
            "input_completeness": F.lit(INPUT_COMPLETENESS),
            "confidence": score,
        }
    )
    band = F.when(F.col("confidence") >= 0.75, "high").when(F.col("confidence") >= 0.45, "medium").otherwise("low")
    return out.withColumn("confidence_band", band)
