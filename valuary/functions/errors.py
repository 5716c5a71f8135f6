"""Prediction error expressions shared by evaluation and monitoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: an estimate within this share of the price counts as a hit.
HIT_BAND = 0.10


def abs_pct_error(actual: Column, predicted: Column) -> Column:
    """|predicted - actual| / actual for a positive actual, else null."""
    return F.when(actual > 0, F.abs((predicted - actual) / actual))


def hit_rate(ape: Column) -> Column:
    """Share of rows with an error inside the band; 0 when no row counts."""
    return F.coalesce(F.avg((ape <= HIT_BAND).cast("double")), F.lit(0.0))


def r_squared(actual: Column, predicted: Column) -> Column:
    """Coefficient of determination; without variance 1 for a perfect fit, else 0."""
    residual = F.sum((actual - predicted) * (actual - predicted))
    total = F.var_pop(actual) * F.count(actual)
    flat = F.min(actual) == F.max(actual)
    return F.when(flat, F.when(residual == 0, 1.0).otherwise(0.0)).otherwise(1 - residual / total)


def valuation_status(actual: Column, predicted: Column, band: float = HIT_BAND) -> Column:
    """Whether a price sits above, below or near its predicted value."""
    gap = F.try_divide(actual - predicted, predicted)
    return (
        F.when(gap >= band, "over_valued").when(gap <= -band, "under_valued").otherwise("near_fair_value")
    )
