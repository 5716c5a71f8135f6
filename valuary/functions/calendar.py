"""Date expressions: periods, seasonality and interest-rate regimes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Origin of the trend feature, end of each rate regime (exclusive) and its label.
TREND_START = "2019-01-01"
REGIME_ENDS = (
    ("2020-03-01", "pre_2020"),
    ("2022-01-01", "pandemic_low_rate"),
    ("2024-01-01", "post_hike_transition"),
)
LAST_REGIME = "high_rate_2024_plus"


def period_label(day: Column, freq: str = "Q") -> Column:
    """Calendar period as text: 2024Q1, 2024-01 or 2024; null for a null date."""
    if freq == "Q":
        return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))
    if freq == "M":
        return F.date_format(day, "yyyy-MM")
    if freq == "Y":
        return F.year(day).cast("string")
    raise ValueError(f"period frequency must be Q, M or Y, got {freq!r}")


def days_since_trend_start(day: Column) -> Column:
    return F.datediff(day, F.lit(TREND_START).cast("date")).cast("double")


def _month_angle(day: Column) -> Column:
    return F.lit(2.0 * math.pi) * (F.coalesce(F.month(day), F.lit(1)) - 1) / F.lit(12.0)


def month_sin(day: Column) -> Column:
    return F.sin(_month_angle(day))


def month_cos(day: Column) -> Column:
    return F.cos(_month_angle(day))


def rate_regime(day: Column) -> Column:
    """Regime of a date; a null date falls into the last one."""
    (end, label), *rest = REGIME_ENDS
    expr = F.when(day < F.lit(end).cast("date"), label)
    for end, label in rest:
        expr = expr.when(day < F.lit(end).cast("date"), label)
    return expr.otherwise(LAST_REGIME)
