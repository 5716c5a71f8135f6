"""Market segments, in-segment price tiers and the target-free tier proxy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuary.functions.parse import lookup, number_of, token_or
from valuary.functions.property import borough_digits, segment
from valuary.operators.ordered import at_or_before, boundary_rows, group_quantiles
from valuary.session import broadcast_if_small, lookup_join, materialise

# Tier names from cheapest to dearest, and the borough part of the proxy score.
TIERS = ("entry", "core", "premium", "luxury")
BOROUGH_PRIOR = {"1": 0.35, "2": -0.12, "3": 0.08, "4": 0.04, "5": -0.15}

MISSING = "__missing__"
GLOBAL_SCOPE = "__global__"
THRESHOLDS = {"q25": 0.25, "q50": 0.50, "q75": 0.75}


def assign_segments(df: DataFrame) -> DataFrame:
    return df.withColumn("property_segment", segment(F.col("building_class_category")))


def assign_price_tiers(df: DataFrame, order: str = "row_order") -> DataFrame:
    """Price tier inside each segment: tier k ends at rank k(n-1)/4, equal prices in input order.

    There are only a handful of segments, so instead of ranking a segment in one task the three
    border rows are located and every row is compared with them.
    """
    borders = boundary_rows(
        df, ["property_segment"], "sale_price", order, lambda n: [F.floor(k * (n - 1) / 4) for k in (1, 2, 3)]
    )
    wide = borders.groupBy("property_segment").agg(
        *[
            F.max(F.when(F.col("i") == k, F.col(c))).alias(f"_{c}{k}")
            for k in range(3)
            for c in ("first", "second")
        ]
    )
    out = lookup_join(df, wide, ["property_segment"])
    tier = F.when(F.col("sale_price").isNull(), F.lit(None).cast("string"))
    for k, name in enumerate(TIERS[:3]):
        border = F.col(f"_first{k}"), F.col(f"_second{k}")
        tier = tier.when(at_or_before(F.col("sale_price"), F.col(order), *border), name)
    out = out.withColumn("price_tier", tier.otherwise(TIERS[3]))
    return out.drop(*[f"_{c}{k}" for k in range(3) for c in ("first", "second")])


def proxy_score(df: DataFrame) -> Column:
    """Price level guessed from size, location, age, units and borough; null when one of the first three is."""

    def number(name: str) -> Column:
        return number_of(df, name)

    def damped(c: Column) -> Column:
        # (c + |c|) / 2 is the non-negative part of c, null for null, and keeps the generated code small.
        return F.log1p((c + F.abs(c)) / 2)

    zero = F.lit(0.0)
    units = F.greatest(F.coalesce(number("total_units"), zero), F.coalesce(number("residential_units"), zero))
    borough = borough_digits(F.col("borough")) if "borough" in df.columns else F.lit(MISSING)
    prior = F.coalesce(lookup(BOROUGH_PRIOR, borough), zero)
    return (
        0.45 * damped(number("gross_square_feet"))
        - 0.30 * damped(number("distance_to_center_km"))
        - 0.15 * damped(number("building_age"))
        + 0.05 * damped(units)
        + 0.05 * prior
    )


def segment_token(df: DataFrame, segment_col: str = "property_segment") -> Column:
    return token_or(F.col(segment_col), MISSING) if segment_col in df.columns else F.lit(MISSING)


def fit_proxy_bins(
    df: DataFrame, segment_col: str = "property_segment", min_segment_rows: int = 800
) -> DataFrame:
    """Score quartiles overall (scope `__global__`) and of each segment with enough scored rows.

    Columns: scope, q25, q50, q75, n. Without any scored row the overall quartiles are 0.
    """
    scored = df.select(segment_token(df, segment_col).alias("segment"), proxy_score(df).alias("score"))
    scoped = scored.select(F.explode(F.array("segment", F.lit(GLOBAL_SCOPE))).alias("scope"), "score")
    bins = group_quantiles(scoped, ["scope"], "score", THRESHOLDS)
    bins = bins.where((F.col("scope") == GLOBAL_SCOPE) | (F.col("n") >= min_segment_rows))
    zero = df.sparkSession.createDataFrame([(GLOBAL_SCOPE, 0.0, 0.0, 0.0, 0)], "scope string, q25 double, q50 double, q75 double, n bigint")
    both = bins.unionByName(zero).groupBy("scope")
    return materialise(both.agg(*[F.max_by(c, "n").alias(c) for c in THRESHOLDS], F.max("n").alias("n")))


def bucketize(score: Column, q25: Column, q50: Column, q75: Column) -> Column:
    """Tier of a score between three thresholds; a missing score counts as core."""
    return (
        F.when(score.isNull(), "core")
        .when(score <= q25, "entry")
        .when(score <= q50, "core")
        .when(score <= q75, "premium")
        .otherwise("luxury")
    )


def assign_proxy_tiers(
    df: DataFrame,
    bins: DataFrame | None = None,
    segment_col: str = "property_segment",
    min_segment_rows: int = 800,
) -> DataFrame:
    """Tier proxy by own-segment thresholds, overall ones as fallback, with a source label."""
    if bins is None:
        bins = fit_proxy_bins(df, segment_col, min_segment_rows)
    overall = bins.where(F.col("scope") == GLOBAL_SCOPE).select(*THRESHOLDS).first()
    own = bins.where(F.col("scope") != GLOBAL_SCOPE).select(
        F.col("scope").alias("_scope"), *[F.col(c).alias(f"_{c}") for c in THRESHOLDS]
    )
    out = df.withColumns({"price_tier_proxy_score": proxy_score(df), "_scope": segment_token(df, segment_col)})
    out = out.join(broadcast_if_small(own), ["_scope"], "left")
    score = F.col("price_tier_proxy_score")
    edges = [F.coalesce(F.col(f"_{c}"), F.lit(overall[c])) for c in THRESHOLDS]
    source = (
        F.when(score.isNull(), "default_core_missing_score")
        .when(F.col("_q25").isNotNull(), F.concat(F.lit("segment:"), "_scope"))
        .otherwise("global_fallback")
    )
    out = out.withColumns({"price_tier_proxy": bucketize(score, *edges), "price_tier_proxy_source": source})
    return out.drop("_scope", *[f"_{c}" for c in THRESHOLDS])
