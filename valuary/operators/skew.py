"""Finding keys that hold an outsized share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1e-3
HOT_MIN_ROWS = 100_000


def hot_keys(
    df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE, min_rows: int = HOT_MIN_ROWS
) -> DataFrame:
    """Keys with more than `share` of all rows (and more than `min_rows`).

    At most 1/share keys can qualify, so the result always fits a broadcast.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    total = counts.agg(F.sum("_rows")).scalar()
    return counts.where(F.col("_rows") > F.greatest(total * F.lit(share), F.lit(float(min_rows)))).select(*keys)
