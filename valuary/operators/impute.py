"""Median imputation from the narrowest group that has a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuary.operators.ordered import group_quantiles
from valuary.session import MAX_LOOKUP_ROWS, materialise

# What is used when a table has no known value at all.
DEFAULT_SQFT = 1200.0
DEFAULT_YEAR = 1960.0


def _fill_from_levels(
    df: DataFrame, known: DataFrame, value: str, levels: list[tuple[str, list[Column]]], default: float
) -> DataFrame:
    """Adds `_fill` and `_level`: the median of the first level that has a positive one.

    All levels are counted in one pass over `known`, as rows (level, k1, k2, value).
    """
    none = F.lit(None).cast("string")
    entries = []
    for name, cols in levels:
        k1, k2 = ([c.cast("string") for c in cols] + [none, none])[:2]
        complete = F.lit(True)
        for c in cols:
            complete = complete & c.isNotNull()
        entries.append(F.when(complete, F.struct(F.lit(name).alias("level"), k1.alias("k1"), k2.alias("k2"))))
    rows = known.select(F.explode(F.array_compact(F.array(*entries))).alias("g"), F.col(value).alias("v"))
    rows = rows.select("g.level", "g.k1", "g.k2", "v")
    medians = materialise(group_quantiles(rows, ["level", "k1", "k2"], "v", {"median": 0.5}))
    small = medians.count() <= MAX_LOOKUP_ROWS

    out = df
    fill, level = None, None
    for at, (name, cols) in enumerate(levels):
        table = medians.where(F.col("level") == name)
        if not cols:
            row = table.select("median").first()
            overall = F.lit(row["median"] if row else default)
            fill = overall if fill is None else fill.otherwise(overall)
            level = F.lit(name) if level is None else level.otherwise(F.lit(name))
            break
        ks = [f"_k{at}_{j}" for j in range(len(cols))]
        table = table.where("median > 0").select(
            *[F.col(f"k{j + 1}").alias(k) for j, k in enumerate(ks)], F.col("median").alias(f"_m{at}")
        )
        out = out.withColumns({k: c.cast("string") for k, c in zip(ks, cols)})
        out = out.join(F.broadcast(table) if small else table, ks, "left").drop(*ks)
        has = F.col(f"_m{at}").isNotNull()
        fill = F.when(has, F.col(f"_m{at}")) if fill is None else fill.when(has, F.col(f"_m{at}"))
        level = F.when(has, name) if level is None else level.when(has, name)
    out = out.withColumns({"_fill": fill, "_level": level})
    return out.drop(*[f"_m{i}" for i in range(len(levels))])


def impute_sqft(df: DataFrame) -> DataFrame:
    """Missing or zero floor area from the median of neighbourhood and class, borough and class, class, city."""
    sqft = F.col("gross_square_feet")
    missing = sqft.isNull() | (sqft == 0)
    levels = [
        ("neighborhood_class", [F.col("neighborhood"), F.col("building_class")]),
        ("borough_class", [F.col("borough"), F.col("building_class")]),
        ("class_only", [F.col("building_class")]),
        ("citywide", []),
    ]
    out = _fill_from_levels(df, df.where(~missing), "gross_square_feet", levels, DEFAULT_SQFT)
    out = out.withColumns(
        {
            "sqft_imputed": missing,
            "sqft_imputation_level": F.when(missing, F.col("_level")),
            "gross_square_feet": F.when(missing, F.col("_fill")).otherwise(sqft),
        }
    )
    return out.drop("_fill", "_level")


def impute_year_built(df: DataFrame) -> DataFrame:
    """Missing or zero construction year from the median of neighbourhood, borough, city, truncated."""
    year = F.col("year_built")
    missing = year.isNull() | (year == 0)
    levels = [("neighborhood", [F.col("neighborhood")]), ("borough", [F.col("borough")]), ("citywide", [])]
    out = _fill_from_levels(df, df.where(~missing), "year_built", levels, DEFAULT_YEAR)
    out = out.withColumns(
        {
            "year_built_imputed": missing,
            "year_built": F.when(missing, F.col("_fill")).otherwise(year.cast("double")).cast("long"),
        }
    )
    return out.drop("_fill", "_level")


def impute_missing_values(df: DataFrame) -> DataFrame:
    return impute_year_built(impute_sqft(df))
